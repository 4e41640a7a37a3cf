"""N-gram Jaccard join: documents whose sets of word shingles overlap by ``percent`` of their union, and their groups.

All sets are in one global order: shingles that many documents share come last, the others by their hash. The join:

1. Equal sets are one class; a class takes part once.
2. Two sets can only link if they share one of their first n - ceil(n * percent / 100) + 1 shingles. These prefixes are
   the roots below which partners are looked for: an index (shingle, class), of which only rows stay that have another
   class below their root whose size allows a link.
3. Below each root a parity sketch of each set, a bound for the difference of two sets that never exceeds it, tells
   which pairs of different components may link. A root gives a spanning forest of those pairs, so it has fewer rows
   than the root has classes. A root of many classes is cut: into salted parts at first, into pairs of blocks at last.
4. Cells of whole sets are met in a prefix tree (prefix_tree.py): walks share the overlaps so far, abandon subtrees by
   the lengths that remain, and give the links that join components. In the first rounds a cell is a star of the
   forest, which merges most of a group of near copies at a comparison or two each. At last the cells are the forest's
   own components, with all their sets, so every pair that may link and still is apart is decided exactly. Large cells
   are cut into pairs of blocks.
5. Components of the links, on Spark (see common.components).

Null and empty texts have empty sets and link with nothing. Rows that repeat a doc_id are vertices of their own; a
component's name is its smallest doc_id. An empty table gives no rows. Columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ROW, components, is_small, join_dimension, join_ids, join_uneven, materialize, only_last_stays, packed_rows, ship, tidy, unpacked_rows
from .prefix_tree import links, needed
from .shingles import mix, shingle_set, word_hashes

PERCENT = 85
SHINGLE_WORDS = 4
#: The most frequent shingles that come last in the global order. The order decides cost, not results.
FREQUENT = 65_536
#: A task reports a shingle if so many of its documents have it.
REPORTED = 8
#: Bits of the filter that selects the texts whose sets are fetched; false hits cost time only.
FILTER_BITS = 1 << 25
#: Classes of a root that are looked at together, and shingles of the sets of a cell; more are cut into parts of about this size.
BLOCK, CELL_KEYS = 512, 1 << 17
#: Below a root of at most so many classes pairs are looked at in one go, else class by class.
SMALL_RUN = 32
#: Rounds in which cells are stars.
STAR_ROUNDS = 2


def prefix_length(n, percent: int = PERCENT):
    return n - -(-n * percent // 100) + 1


def _sets(source: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in bpe.batches(source, "text", 4 << 20):
        yield batch, [shingle_set(w, words) for w in word_hashes(batch.column("text"))]
    tidy()


def _ordered(keys: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    if not len(frequent) or not len(keys):
        return keys
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    hot = frequent[at] == keys
    if not hot.any():
        return keys
    return np.concatenate([keys[~hot], keys[hot][np.argsort(rank[at[hot]], kind="stable")]])


def sketch(keys: np.ndarray) -> bytes:
    """Parities of the numbers of keys in 2**k >= n cells: two sets differ in as many keys at least as in cells."""
    bits = 128
    while bits < len(keys):
        bits *= 2
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _digest(keys: np.ndarray) -> tuple[int, int]:
    a, b = mix(keys ^ np.uint64(0x5851F42D4C957F2D)), mix(keys + np.uint64(0x14057B7EF767814F))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(b).astype(np.int64)) if len(b) else 0


def frequent_shingles(docs: DataFrame, words: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` shingles that many documents share, sorted, and their ranks by the number of documents."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        open_: list[np.ndarray] = []

        def close():
            if open_:
                keys, n = np.unique(np.concatenate(open_), return_counts=True)
                found.append((keys[n > 1], n[n > 1]))
                open_.clear()

        size = 0
        for _, sets in _sets(source, words):
            open_ += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                close()
                size = 0
        close()
        if found:
            keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in found]).astype(float), len(keys)).astype(np.int64)
            keep = n >= REPORTED
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].astype(np.int64)), pa.array(n[keep])], ["shingle", "n"])

    top = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    got = top.orderBy(F.desc("n"), "shingle").limit(most).toPandas()  # at most ``most`` rows
    keys = got["shingle"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(np.int64)[order]


def describe(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's digest), prefix (in the global order), sketch, and the columns beside doc_id and text."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(source, words):
            digests = [_digest(s) for s in sets]
            prefixes = [_ordered(s, *frequent)[: prefix_length(len(s), percent) if len(s) else 0].astype(np.int64) for s in sets]
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in digests], pa.int64()),
                    pa.array([b for _, b in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefixes))),
                    pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary()),
                    *[batch.column(c) for c in more],
                ],
                ["doc_id", "n", "s1", "s2", "prefix", "sketch", *more],
            )

    kinds = dict(docs.dtypes)
    rest = "".join(f", {c} {kinds[c]}" for c in more)
    return docs.select("doc_id", "text", *more).mapInArrow(run, f"doc_id {kinds['doc_id']}, n long, s1 long, s2 long, prefix array<long>, sketch binary{rest}")


class Sketches:
    """A column of sketches, by row."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
        self.start, self.cells = at[:-1], np.diff(at)
        self.flat = np.frombuffer(column.buffers()[2] or b"", np.uint64)

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The rows' sketches with so many words: a cell of the half is the parity of cells i and i + half."""
        out = np.zeros((len(rows), size), np.uint64)
        for c in np.unique(self.cells[rows]):
            some = np.flatnonzero(self.cells[rows] == c)
            x = self.flat[self.start[rows[some]][:, None] + np.arange(c)]
            while x.shape[1] > size:
                half = x.shape[1] // 2
                x = x[:, :half] ^ x[:, half:]
            out[some] = x
        return out

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing cells of pairs of rows."""
        out, size = np.zeros(len(i), np.int64), np.minimum(self.cells[i], self.cells[j])
        for s in np.unique(size):
            same = np.flatnonzero(size == s)
            for at in range(0, len(same), 8192):
                own = same[at : at + 8192]
                rows, back = np.unique(np.concatenate([i[own], j[own]]), return_inverse=True)
                cells = self.folded(rows, int(s))
                out[own] = np.bitwise_count(cells[back[: len(own)]] ^ cells[back[len(own) :]]).sum(axis=1, dtype=np.int64)
        return out


def _whole_runs(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A stream sorted by keys, cut only between runs of equal keys; the runs' bounds. Runs are bounded."""
    rest: list[pa.RecordBatch] = []

    def bounds(batch) -> np.ndarray:
        differ = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            differ |= np.diff(batch.column(k).to_numpy()) != 0
        return np.concatenate([[0], np.flatnonzero(differ) + 1, [batch.num_rows]])

    for batch in source:
        if not batch.num_rows:
            continue
        last = int(bounds(batch)[-2])
        same = bool(rest) and all(rest[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if rest and (last or not same):
            table = pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
            rest = []
            yield table, bounds(table)
        elif last:
            table = pa.Table.from_batches([batch.slice(0, last)])
            yield table, bounds(table)
        rest.append(batch.slice(last))
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, bounds(table)


def _n_parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _fits(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and places allow a link, if the root is the first shingle that both have (else that one serves them)."""
    return 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1) >= needed(n[i], n[j], percent)


def _shared(index: DataFrame, percent: int) -> DataFrame:
    """The rows of an index (shingle, id, n, place) with a possible partner below their root.

    Rows are dealt by ranges of shingle and id, so a root of many classes is cut over tasks; a task's first and last
    root, which may go on in the next one, stay whole, and so do long ones.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the last rows, which the next batch may go on
        first = True
        for batch in source:
            if not batch.num_rows:
                continue
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            key, n, place = (batch.column(c).to_numpy() for c in ("shingle", "n", "place"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            sizes = np.diff(cuts)
            of_run = np.repeat(sizes, sizes)
            keep = of_run > SMALL_RUN
            for d in range(1, min(SMALL_RUN, len(key))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (of_run[d:] <= SMALL_RUN))
                if not len(i):
                    break
                i = i[_fits(n, place, i, i + d, percent)]
                keep[i] = keep[i + d] = True
            if first:
                keep[: cuts[1]] = True
            last = int(cuts[-2])
            if len(key) - last > SMALL_RUN:  # a long root: its rows go out, all but the one that makes the rest of it long
                keep[last:] = True
                last, long = len(key) - 1, True
            else:
                long = False
            first = long or (first and last == 0)
            out = batch.slice(0, last).filter(pa.array(keep[:last]))
            kept = batch.slice(last)
            if out.num_rows:
                yield out
        if kept is not None:
            yield kept

    rows = index.repartitionByRange(_n_parts(index), "shingle", "id").sortWithinPartitions("shingle", "id")
    return rows.mapInArrow(run, index.schema)


def _pairs(r: dict, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a run, of different components and sides, that sizes, places and sketches allow to link."""
    n, comp, sketches = r["n"], r["component"], r["sketch"]

    def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (comp[i] != comp[j]) & _fits(n, r["place"], i, j, percent)
        i, j = i[ok], j[ok]
        ok = sketches.differ(i, j) <= n[i] + n[j] - 2 * needed(n[i], n[j], percent)
        return i[ok], j[ok]

    sizes = np.diff(bounds)
    mixed = np.minimum.reduceat(comp, bounds[:-1]) != np.maximum.reduceat(comp, bounds[:-1])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = (mixed & (sizes <= SMALL_RUN))[run]
    for d in range(1, min(SMALL_RUN, len(run))):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
        if not len(i):
            break
        i, j = may(i, i + d)
        left.append(i)
        right.append(j)
    for k in np.flatnonzero(mixed & (sizes > SMALL_RUN)):  # rows are sorted by n
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        upto = np.searchsorted(n[lo:hi], n[lo:hi] * 100 // percent, "right") - np.arange(1, hi - lo + 1)
        i = np.repeat(np.arange(lo, hi), upto)
        i, j = may(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(upto) - upto, upto))
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _spanning(i: np.ndarray, j: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows, as (hub, member): rows with many partners are hubs."""
    degree = np.bincount(np.concatenate([i, j]), minlength=rows)
    swap = (degree[j] > degree[i]) | ((degree[j] == degree[i]) & (j < i))
    hub, member = np.where(swap, j, i), np.where(swap, i, j)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for k in np.lexsort((hub, -degree[hub])):
        a, b = find(int(hub[k])), find(int(member[k]))
        if a != b:
            parent[b] = a
            out.append((int(hub[k]), int(member[k])))
    return out


def _forest(runs: DataFrame, percent: int) -> DataFrame:
    """hub, member: of each run (shingle, i, j) a spanning forest of the pairs that may link and are of different components."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_runs(source, ["shingle", "i", "j"]):
            r = {c: table.column(c).to_numpy() for c in ("place", "id", "n", "component")}
            r["sketch"] = Sketches(table.column("sketch").combine_chunks())
            i, j = _pairs(r, bounds, percent)
            found = np.array(_spanning(i, j, len(r["id"])), np.int64).reshape(-1, 2)
            ids = np.unique(r["id"][found], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["hub", "member"])
        tidy()

    key = ["shingle", "i", "j"]
    rows = runs.repartition(_n_parts(runs), *key).sortWithinPartitions(*key, "n", "id")
    return rows.mapInArrow(run, "hub long, member long").distinct()


def _dealt(seed: int, blocks: Column, *by: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *by), blocks)


def _block_pairs(own: Column, main: Column, others: Column, mains: Column) -> Column:
    """The pairs of blocks i <= j in which a row takes part: of blocks of others with each other and with main ones."""
    total = others + mains
    zero = F.lit(0).cast("long")
    every = F.transform(F.sequence(zero, total - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    to_others = F.transform(F.sequence(zero, others - 1), lambda k: F.struct(k.alias("i"), own.alias("j")))
    return F.when(~main, every).when(others > 0, to_others).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))


def _runs(index: DataFrame, about: DataFrame, round_: int, block: int = BLOCK) -> DataFrame:
    """The index's rows with component and sketch, in runs (shingle, i, j) of bounded size.

    In the first rounds a root of many classes is dealt over parts. At last it is cut into blocks that meet in pairs,
    but for pairs of blocks of its commonest component.
    """
    if round_ > 1:  # only roots of several components matter
        placed = index.join(about.select("id", "component"), "id")
        mixed = placed.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("shingle")
        index = materialize(join_ids(index, materialize(mixed, "jaccard-mixed"), "shingle", "left_semi"), "jaccard-index")
    rows = index.join(about.select("id", "component", "sketch"), "id")
    hot = materialize(index.groupBy("shingle").agg(F.count("*").alias("c")).where(F.col("c") > block), "jaccard-hot")
    parts = lambda c: F.ceil(F.col(c) / block)
    if round_ <= STAR_ROUNDS:
        part = F.when(F.col("c").isNull(), F.lit(0)).otherwise(_dealt(round_, parts("c"), "id", "shingle")).cast("long")
        return join_dimension(rows, hot, ["shingle"], "left").withColumn("i", part).withColumn("j", F.col("i")).drop("c")
    some = join_dimension(index.select("shingle", "id"), hot, ["shingle"]).join(about.select("id", "component"), "id")
    by = some.groupBy("shingle", "component").agg(F.count("*").alias("k"), F.first("c").alias("c"))
    main = by.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("m"), F.first("c").alias("c"))
    main = main.select("shingle", F.col("m.component").alias("main"), F.ceil((F.col("c") - F.col("m.k")) / block).alias("others"), F.ceil(F.col("m.k") / block).alias("mains"))
    rows = join_dimension(rows, materialize(main, "jaccard-main"), ["shingle"], "left")
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, F.col("others") + _dealt(0, F.col("mains"), "id", "shingle")).otherwise(_dealt(0, F.greatest(F.lit(1), F.col("others")), "id", "shingle"))
    pairs = F.when(F.col("main").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(_block_pairs(own, is_main, F.col("others"), F.col("mains")))
    return rows.withColumn("ij", F.explode(pairs)).select("shingle", "id", "n", "place", "component", "sketch", "ij.i", "ij.j")


def _cells(edges: DataFrame, about: DataFrame, round_: int, keys: int = CELL_KEYS) -> DataFrame:
    """cell, i, j, id, component, is_hub: which sets meet."""
    known = about.select("id", "n", "component")
    if round_ <= STAR_ROUNDS:
        member = edges.select(F.col("hub").alias("cell"), F.col("member").alias("id")).join(known, "id")
        parts = member.groupBy("cell").agg(F.ceil(F.sum("n") / keys).alias("parts"))
        hubs = parts.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.col("cell").alias("id")).join(known, "id")
        large = materialize(parts.where("parts > 1"), "jaccard-large")
        part = F.coalesce(_dealt(round_, F.col("parts"), "id", "cell"), F.lit(0)).cast("long")
        member = join_dimension(member, large, ["cell"], "left").withColumn("i", part)
        each = [t.select("cell", "i", F.col("i").alias("j"), "id", "component", F.lit(hub).alias("is_hub")) for t, hub in ((member, False), (hubs, True))]
        return each[0].unionByName(each[1])
    # components of the forest; its vertices that are no component's smallest come with it, the smallest themselves too
    group = components(edges.select(F.col("hub").alias("a"), F.col("member").alias("b")), "jaccard-meeting")
    group = group.unionByName(group.select(F.col("component").alias("id"), "component").distinct())
    rows = group.select("id", F.col("component").alias("cell")).join(known, "id")
    sums = rows.groupBy("cell").agg(F.sum("n").alias("keys"))
    large = materialize(sums.where(F.col("keys") > keys).select("cell", F.ceil(2 * F.col("keys") / keys).alias("blocks")), "jaccard-large")
    rows = join_dimension(rows, large, ["cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    pairs = _block_pairs(_dealt(0, F.col("blocks"), "id"), F.lit(False), F.col("blocks"), F.lit(0).cast("long"))
    return rows.withColumn("ij", F.explode(pairs)).select("cell", "ij.i", "ij.j", "id", "component", F.lit(False).alias("is_hub"))


def _meet(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join components, from each cell's prefix tree."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_runs(source, ["cell", "i", "j"]):
            ids, component, hub = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "is_hub"))
            keys, found = table.column("keys").combine_chunks(), []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if (component[lo:hi] != component[lo]).any():
                    # the shingles that most sets share come first in the tree
                    own = [np.frombuffer(keys[int(k)].as_py(), np.uint64)[::-1] for k in range(lo, hi)]
                    found += links(ids[lo:hi], component[lo:hi], own, hub[lo:hi].astype(bool), percent)
            out = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])
        tidy()

    key = ["cell", "i", "j"]
    cells = materialize(cells, "jaccard-cells")
    cells = F.broadcast(cells) if is_small(cells) else cells
    rows = sets.join(cells, "id").repartition(_n_parts(sets), *key).sortWithinPartitions(*key, "id")
    return rows.mapInArrow(run, "a long, b long")


def fetch_sets(docs: DataFrame, wanted: DataFrame, frequent, words: int) -> DataFrame:
    """id, keys of the wanted classes (id, doc_id, s1, s2): texts are read again, and a filter drops most.

    A task gives a set once. Where a row is repeated over tasks its set is, which does no harm.
    """

    def slots(s1, s2, h) -> np.ndarray:
        s1, s2, h = (np.asarray(x, np.int64).astype(np.uint64) for x in (s1, s2, h))
        return (mix(s1 ^ (s2 * np.uint64(3)) ^ mix(h)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)

    def mark(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [slots(*(b.column(c).to_numpy() for c in ("s1", "s2", "h"))) for b in source]
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *got]))
        yield pa.RecordBatch.from_arrays([pa.array(at)], ["slot"])

    about_id = F.xxhash64("doc_id").alias("h")
    bits = wanted.select("s1", "s2", about_id).mapInArrow(mark, "slot long").groupBy((F.col("slot") / 64).cast("long").alias("word"))
    words_ = bits.agg(F.expr("bit_or(shiftleft(1L, int(pmod(slot, 64L))))").alias("v")).toPandas()  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words_["word"].to_numpy(np.int64)] = words_["v"].to_numpy(np.int64).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch, sets in _sets(source, words):
            digests = [_digest(s) for s in sets]
            at = slots([a for a, _ in digests], [b for _, b in digests], batch.column("h").to_numpy())
            hit = np.flatnonzero((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            own = {(*digests[k], int(batch.column("h")[int(k)].as_py())): int(k) for k in hit[::-1] if len(sets[k])}
            hit = sorted(k for x, k in own.items() if x not in seen)
            seen.update(own)
            keys = [_ordered(sets[k], *frequent).astype("<u8").tobytes() for k in hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(hit, pa.int64())), pa.array([digests[k][0] for k in hit], pa.int64()), pa.array([digests[k][1] for k in hit], pa.int64()), pa.array(keys, pa.binary())],
                ["f_doc_id", "f1", "f2", "keys"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted
    found = docs.select("doc_id", about_id, "text").mapInArrow(run, f"f_doc_id {kind}, f1 long, f2 long, keys binary")
    out = found.join(wanted, (F.col("f1") == F.col("s1")) & (F.col("f2") == F.col("s2")) & F.col("f_doc_id").eqNullSafe(F.col("doc_id")))
    return materialize(out.select("id", "keys"), "jaccard-sets")


def _linked_classes(docs: DataFrame, reps: DataFrame, frequent, words: int, percent: int) -> DataFrame | None:
    """id, component of the classes that have links; reps: id, doc_id, n, s1, s2, prefix, sketch."""
    place = reps.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "shingle"))
    index = materialize(_shared(place.select("shingle", "id", "n", "place"), percent), "jaccard-index")
    index = index.withColumns({c: F.col(c).cast("long") for c in ("n", "place")})
    sets, comps = None, None
    for round_ in range(1, STAR_ROUNDS + 2):
        about = reps.select("id", "n", "sketch")
        if comps is None:
            about = about.withColumn("component", F.col("id"))
        else:
            about = materialize(about.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-about")
        edges = materialize(_forest(_runs(index, about, round_), percent), "jaccard-forest")
        if round_ == 1:
            # what has no partner here has none later, but below roots that were dealt over parts
            cut = index.groupBy("shingle").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).drop("c")
            cut = join_dimension(index.select("shingle", "id"), cut, ["shingle"]).select("id")
            ids = materialize(edges.select(F.col("hub").alias("id")).union(edges.select("member")).union(cut).distinct(), "jaccard-partners")
            reps = materialize(reps.drop("prefix").join(ids, "id", "left_semi"), "jaccard-reps")
            index = materialize(index.join(ids, "id", "left_semi"), "jaccard-index")
            about = reps.select("id", "n", "sketch").withColumn("component", F.col("id"))
            if reps.isEmpty():
                return None
            sets = fetch_sets(docs, reps.select("id", "doc_id", "s1", "s2"), frequent, words)
        if edges.isEmpty():
            continue
        found = materialize(_meet(_cells(edges, about, round_), sets, percent), "jaccard-links")
        if not found.isEmpty():
            # the links so far are as good as their components: stars
            known = found if comps is None else found.unionByName(comps.select(F.col("id").alias("a"), F.col("component").alias("b")))
            comps = components(known, "jaccard-components")
    return comps


def _members(docs: DataFrame, percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """Of docs (doc_id, text and others) doc_id, n, row, the others, and component: one of the component's rows, null for a row alone."""
    ship(docs.sparkSession)
    with only_last_stays(docs.sparkSession):
        return _found_members(docs, percent, words)


def _found_members(docs: DataFrame, percent: int, words: int) -> DataFrame:
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    frequent = frequent_shingles(docs, words)
    rows = materialize(describe(docs, frequent, words, percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    full = rows.where("n > 0")
    classes = materialize(full.groupBy("n", "s1", "s2").agg(F.min("row").alias("id"), F.count("*").alias("copies")), "jaccard-classes")
    copies = full.select(F.col("row").alias("id")).join(classes.select("id"), "id", "left_anti")
    reps = full.select("doc_id", "n", "s1", "s2", "prefix", "sketch", F.col("row").alias("id"))
    reps = join_ids(reps, materialize(copies, "jaccard-copies"), "id", "left_anti")
    comps = _linked_classes(docs, materialize(reps, "jaccard-reps"), frequent, words, percent)
    named = rows.select("doc_id", "n", "s1", "s2", "row", *more)
    known = classes.where("copies > 1").withColumn("component", F.col("id"))
    if comps is not None:
        # a component's own name has no row of its own there
        known = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        names = comps.select(F.col("component").alias("id")).distinct().withColumn("named", F.lit(True))
        known = known.join(names, "id", "left").where("copies > 1 or component <> id or named").drop("named")
    known = materialize(known.select("n", "s1", "s2", "component", "copies"), "jaccard-known")
    member = join_uneven(named, known, ["n", "s1", "s2"], "copies", F.col("n") > 0)
    return materialize(member.select("doc_id", "n", "row", *more, "component"), "jaccard-members")


def groups(docs: DataFrame, percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    member = _members(docs.select("doc_id", "text"), percent, words)
    # a component's smallest doc_id; the aggregate combines before it shuffles
    smallest = member.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("members"))
    named = join_uneven(member, materialize(smallest, "jaccard-smallest"), ["component"], "members", F.col("component").isNotNull())
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each group one row: of those with the smallest doc_id (null last) the first by its text's digest; rows without a group stay."""
    whole, names = packed_rows(docs)
    digest = F.unhex(F.md5("text"))
    key = lambda t, more="": [F.col(f"{t}doc_id").alias(f"{more}doc_id"), F.col(f"{t}digest").alias(f"{more}digest")]
    found = _members(docs.select("doc_id", "text", digest.alias("digest")), **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"), F.col("digest"))).alias("first")
    kept = found.where("component is not null").groupBy("component").agg(first)
    kept = materialize(kept.select(*key("first.", "k_"), F.lit(True).alias("kept")), "jaccard-kept")
    # what goes; and what stays once though its row is repeated. Both are mostly few, and texts then are not shuffled
    grouped = found.where("component is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("times"))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("digest").eqNullSafe(F.col("k_digest"))
    marked = grouped.join(kept, same, "left").where("kept is null or times > 1")
    marked = materialize(marked.select(*key("", "k_"), F.col("kept").alias("k_kept")), "jaccard-marked")
    rows = docs.select(whole, "doc_id", digest.alias("digest"))
    rows = join_ids(rows, marked, same, "left")
    # one of the repeated rows: a task keeps one of each before the shuffle
    repeated = rows.where("k_kept").groupBy("doc_id", "digest").agg(F.min_by(ROW, F.xxhash64(ROW)).alias(ROW))
    unmarked = rows.where(F.col("k_kept").isNull() & F.col("k_digest").isNull())
    return unpacked_rows(unmarked.select(ROW).unionByName(repeated.select(ROW)), names)
