"""Hard negatives by exact integer inner products, several candidates to a multiplication (Kronecker packing).

Rows are cut into blocks where they are read; anchors are gathered from the blocks into blocks of their own. Each block
of anchors meets each block of rows, dealt as a grid over tasks. In a pair of blocks the candidates' whole-numbered
components are biased to be 0 or more, and as many candidates as fit are put into fields of one wide number: one
multiplication by an anchor's (biased) component serves them all, and a field is wide enough that the sum over all
components never reaches the next. Numbers are held in the 53 bits that a double holds exactly, so that matrix products
compute them. Fields are cut out again and the biases taken off: the scores are exact. Where not even one field fits
(very large components), components are cut into digits, whose products fit.

Two rounds: the first finds each anchor's positives among the rows of its label; the second takes the rows of other
labels whose score lies in the band below a positive's. Each keeps the few best of a pair of blocks, and the best of
those.

A component x counts as floor(256 * x). Rows without vec_id or label, and vectors that are null or hold a null or
non-finite component (or one that overflows when multiplied by 256) take no part. A vector that is shorter than another
is filled up with zeros. Rows that repeat a vec_id are rows of their own: each anchor, candidate and positive counts;
a row is never its own positive. Equal scores go to the smaller vec_id. Scores beyond a long are clipped to it. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, tidy

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST_PERCENT = 80

#: Rows of a block, anchors of a block (about), anchors whose scores are looked at together.
BLOCK, ANCHORS, SLICE = 4096, 1024, 256
#: Blocks of either side that meet in one task.
MEET = 16
#: Bits that a double holds exactly.
EXACT = 53
LONG = (1 << 63) - 1

_BLOCK = "block long, n int, width int, least double, most double, ids binary, labels binary, parts binary"


def _rows(vectors: DataFrame, label: Column) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(SCALE)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)


def _pack(block: int, ids: np.ndarray, labels: np.ndarray, parts: np.ndarray) -> dict:
    return {
        "block": block,
        "n": len(ids),
        "width": parts.shape[1],
        "least": float(parts.min(initial=0.0)),
        "most": float(parts.max(initial=0.0)),
        "ids": ids.astype("<i8").tobytes(),
        "labels": labels.astype("<i8").tobytes(),
        "parts": parts.astype("<f8").tobytes(),
    }


def _unpack(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[side + c], "<i8") for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[side + "parts"], "<f8").reshape(len(ids), row[side + "width"])


def blocks(rows: DataFrame) -> DataFrame:
    """The rows (vec_id, label, v) in blocks of at most BLOCK, each in the order of vec_id; nothing is shuffled."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, made = [], 0, TaskContext.get().partitionId() << 32
        for batch in source:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                yield one(table.slice(0, BLOCK), made)
                held, n, made = table.slice(BLOCK).to_batches(), n - BLOCK, made + 1
        if n:
            yield one(pa.Table.from_batches(held), made)
        tidy()

    def one(table: pa.Table, number: int) -> pa.RecordBatch:
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = table.column("v").combine_chunks()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.zeros((len(ids), int(sizes.max(initial=0))))
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
        parts[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_pylist([_pack(number, ids[order], labels[order], parts[order])], schema=SCHEMA)

    return materialize(rows.mapInArrow(cut, _BLOCK), "negatives-blocks")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in _BLOCK.split(", "))])


def anchor_blocks(cut: DataFrame, every: int) -> tuple[DataFrame, int]:
    """The rows whose vec_id is divisible by ``every``, with the block and place that they come from; and the blocks' number."""

    def pick(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                ids, labels, parts = _unpack(row)
                for k in np.flatnonzero(ids % every == 0).tolist():
                    yield pa.RecordBatch.from_pylist([{"home": row["block"], "place": k, "vec_id": int(ids[k]), "label": int(labels[k]), "v": parts[k].tolist()}], schema=schema)

    schema = pa.schema([("home", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64()))])
    rows = materialize(cut.mapInArrow(pick, "home long, place int, vec_id long, label long, v array<double>"), "negatives-anchors")
    n = -(-rows.count() // ANCHORS)

    def gather(table: pa.Table) -> pa.Table:
        ids, labels, home, place = (table.column(c).to_numpy() for c in ("vec_id", "label", "home", "place"))
        width = max((len(v) for v in table.column("v").to_pylist()), default=0)
        parts = np.array([v + [0.0] * (width - len(v)) for v in table.column("v").to_pylist()], np.float64).reshape(len(ids), width)
        own = {"homes": home.astype("<i8").tobytes(), "places": place.astype("<i8").tobytes()}
        return pa.Table.from_pylist([_pack(table.column("block")[0].as_py(), ids, labels, parts) | own], schema=SCHEMA.append(pa.field("homes", pa.binary())).append(pa.field("places", pa.binary())))

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("home", "place"), F.lit(max(n, 1))))
    return materialize(keyed.groupBy("block").applyInArrow(gather, f"{_BLOCK}, homes binary, places binary"), "negatives-anchor-blocks"), n


class Packed:
    """Candidates' components in fields of wide numbers. ``reach``: how far anchors' components go (least, most)."""

    def __init__(self, parts: np.ndarray, reach: tuple[float, float]) -> None:
        self.n, self.parts, self.width = len(parts), parts, parts.shape[1]
        self.low, self.other = min(parts.min(initial=0.0), 0.0), min(reach[0], 0.0)
        most = int(parts.max(initial=0.0) - self.low) * int(reach[1] - self.other) * max(self.width, 1)
        self.bits = max(most, 1).bit_length()
        self.fields = EXACT // self.bits
        if self.fields:
            self.step = -(-self.n // self.fields)
            wide = np.zeros((self.step, self.width))
            for k in range(self.fields):
                own = parts[k * self.step : (k + 1) * self.step]
                wide[: len(own)] += (own - self.low) * float(1 << (k * self.bits))
            self.wide = np.ascontiguousarray(wide.T)
            self.sums = parts.sum(axis=1).astype(np.int64)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors by candidates."""
        if anchors.shape[1] != self.width:
            width = max(anchors.shape[1], self.width)
            fill = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
            return Packed(fill(self.parts), (anchors.min(initial=0.0), anchors.max(initial=0.0))).scores(fill(anchors))
        if not self.fields:
            return _by_digits(anchors, self.parts)
        product = ((anchors - self.other) @ self.wide).astype(np.int64)
        cells = [(product >> np.int64(k * self.bits)) & np.int64((1 << self.bits) - 1) for k in range(self.fields)]
        out = np.concatenate(cells, axis=1)[:, : self.n] if len(cells) > 1 else cells[0]
        low, other = int(self.low), int(self.other)
        # (a - other)(x - low) = a x - low a - other x + low other, summed over the components
        return out + low * anchors.sum(axis=1).astype(np.int64)[:, None] + other * self.sums[None, :] - low * other * self.width


def _by_digits(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Components in digits of so few bits that sums of their products are exact; clipped to a long."""
    bits = (EXACT - max(a.shape[1], 1).bit_length()) // 2

    def digits(m: np.ndarray) -> list[np.ndarray]:
        size, sign, out = np.abs(m), np.sign(m), []
        while size.any():
            high = np.floor(size / float(1 << bits))
            out.append(sign * (size - high * float(1 << bits)))
            size = high
        return out

    total = np.zeros((len(a), len(x)), object)
    for i, p in enumerate(digits(a)):
        for j, q in enumerate(digits(x)):
            total = total + ((p @ q.T).astype(np.int64).astype(object) << (bits * (i + j)))
    return np.clip(total, -LONG, LONG).astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, column: np.ndarray, k: int) -> np.ndarray:
    """Of each group, where its first k are: by score from above, then by column."""
    order = np.lexsort((column, -score, group))
    g = group[order]
    begins = np.r_[0, np.flatnonzero(np.diff(g)) + 1] if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.r_[begins, len(g)]))
    return order[rank < k]


def _best(scores: np.ndarray, k: int, out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best columns, without column ``out[row]`` where that is not -1."""
    if out is not None:
        here = np.flatnonzero(out >= 0)
        if len(here):
            found = [_best(np.delete(scores[[r]], out[r], axis=1), k, None) for r in here]
            rest = np.flatnonzero(out < 0)
            rows, columns = _best(scores[rest], k, None)
            return (
                np.concatenate([rest[rows], *[np.full(len(c), r) for r, (_, c) in zip(here, found)]]),
                np.concatenate([columns, *[c + (c >= out[r]) for r, (_, c) in zip(here, found)]]),
            )
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    rows, columns = np.nonzero(scores >= least[:, None])
    keep = _first(rows, scores[rows, columns], columns, k)
    return rows[keep], columns[keep]


def _meet(anchors: DataFrame, n_anchors: int, cut: DataFrame, n_blocks: int) -> DataFrame:
    """A row for each block of anchors and each of rows, dealt as a grid: either side is repeated for the groups of the other."""
    a_groups, b_groups = -(-n_anchors // MEET), -(-n_blocks // MEET)
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    left = left.withColumn("g", F.pmod(F.xxhash64("a_block"), F.lit(a_groups)).cast("int")).withColumn("h", grid(b_groups))
    right = cut.withColumn("h", F.pmod(F.xxhash64("block"), F.lit(b_groups)).cast("int")).withColumn("g", grid(a_groups))
    return left.join(right, ["g", "h"]).drop("g", "h")


def _positives(pairs: DataFrame, reach: tuple[float, float], k: int) -> DataFrame:
    """block, row (an anchor's), id, score: the rows of the anchor's label, of each pair of blocks the k best."""

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                (_, mine, a), (ids, labels, x) = _unpack(row, "a_"), _unpack(row)
                home, place = (np.frombuffer(row["a_" + c], "<i8") for c in ("homes", "places"))
                own = np.where(home == row["block"], place, -1)
                for label in np.intersect1d(mine, labels).tolist():
                    columns = np.flatnonzero(labels == label)
                    packed, here = Packed(x[columns], reach), np.flatnonzero(mine == label)
                    for part in (here[k0 : k0 + SLICE] for k0 in range(0, len(here), SLICE)):
                        scores = packed.scores(a[part])
                        r, c = _best(scores, k, np.where(own[part] >= 0, np.searchsorted(columns, own[part]), -1))
                        if len(r):
                            yield _found(row["a_block"], part[r], ids[columns[c]], scores[r, c])
        tidy()

    return pairs.mapInArrow(search, "block long, row int, id long, score long")


def _found(block: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array(np.full(len(rows), block)), "row": pa.array(rows.astype(np.int32)), "id": pa.array(ids), "score": pa.array(scores)} | {c: pa.array(x) for c, x in more.items()})


def _negatives(pairs: DataFrame, reach: tuple[float, float], k: int, least_percent: int) -> DataFrame:
    """block, row, id, score, nth: the rows of other labels in the band of the nth positive, of each pair of blocks the k best."""

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = packed = None
        for batch in source:
            for row in batch.to_pylist():
                (_, mine, a), (ids, labels, x) = _unpack(row, "a_"), _unpack(row)
                if last != row["block"]:
                    last, packed = row["block"], Packed(x, reach)
                wanted = sorted((p["row"], p["nth"], p["score"]) for p in row["positives"])
                who, nth, top = (np.array(z, np.int64) for z in zip(*wanted)) if wanted else (np.zeros(0, np.int64),) * 3
                low = np.array([-((-least_percent * s) // 100) for s in top.tolist()], object)
                low = np.array([min(v, LONG) for v in low], np.int64)
                for at in range(0, len(a), SLICE):
                    scores = packed.scores(a[at : at + SLICE])
                    here = np.flatnonzero((who >= at) & (who < at + SLICE))
                    if not len(here):
                        continue
                    # the widest band of each anchor first: few rows are in any
                    bottom, above = np.full(len(scores), LONG), np.full(len(scores), -LONG)
                    np.minimum.at(bottom, who[here] - at, low[here])
                    np.maximum.at(above, who[here] - at, top[here])
                    r, c = np.nonzero((scores >= bottom[:, None]) & (scores <= above[:, None]) & (mine[at : at + SLICE, None] != labels[None, :]))
                    s = scores[r, c]
                    for n in np.unique(nth[here]).tolist():
                        of = here[nth[here] == n]
                        b, t = np.full(len(scores), LONG), np.full(len(scores), -LONG)
                        b[who[of] - at], t[who[of] - at] = low[of], top[of]
                        ok = np.flatnonzero((s >= b[r]) & (s <= t[r]))
                        ok = ok[_first(r[ok], s[ok], c[ok], k)]
                        if len(ok):
                            yield _found(row["a_block"], r[ok] + at, ids[c[ok]], s[ok], nth=np.full(len(ok), n, np.int32))
        tidy()

    return pairs.mapInArrow(search, "block long, row int, id long, score long, nth int")


def _top(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col(rank) <= k)


def mine(vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank."""
    spark = vectors.sparkSession
    cut = blocks(_rows(vectors, F.col("label") if label is None else label))
    anchors, n_anchors = anchor_blocks(cut, every)
    size = cut.agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    reach = (size["least"], size["most"])
    found = _positives(_meet(anchors, n_anchors, cut, size["n"]), reach, positives)
    found = materialize(_top(found, ["block", "row"], positives, "nth"), "negatives-positives")
    wanted = found.groupBy("block").agg(F.collect_list(F.struct("row", "nth", "score")).alias("positives"))  # of one block's anchors
    pairs = _meet(anchors.join(wanted, "block"), n_anchors, cut, size["n"]).withColumnRenamed("a_positives", "positives")
    picked = _top(_negatives(pairs, reach, negatives, least_percent), ["block", "row", "nth"], negatives, "rank")
    names = anchors.mapInArrow(_names, "block long, row int, anchor_id long")
    out = picked.join(found.select("block", "row", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "row", "nth"]).join(names, ["block", "row"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("nth").alias("positive_rank"))


def _names(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for row in batch.select(["block", "ids"]).to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            yield pa.record_batch({"block": pa.array(np.full(len(ids), row["block"])), "row": pa.array(np.arange(len(ids), dtype=np.int32)), "anchor_id": pa.array(ids)})


def shifted_label() -> Column:
    """The query's labels: of rows whose vec_id is divisible by 7 the next one, modulo 10."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
