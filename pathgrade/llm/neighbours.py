"""Approximate nearest neighbours by cosine: inverted lists with an adaptive scan of dimensions.

Index: unit vectors are turned by a fixed random rotation, assigned to the nearest of ``lists`` centres (k-means on a
bounded sample: at most SAMPLE vectors, those with the smallest hashes), and stored by list in blocks of about BLOCK
vectors, each block as columns of WIDTH dimensions. Every vector is indexed; a large list has many blocks.

Search: queries are gathered by probed list, in groups of at most about GROUP, and meet each block of the list. After
each column block the squared distance so far, scaled to all dimensions, is tested: a candidate is abandoned once it
exceeds the query's bound by more than chance explains (1 + EPSILON / sqrt(dimensions seen)). The nearest FIRST_PROBES
lists are scanned first; the k-th best of them bounds the scan of the others. Those left are scored
exactly on the original vectors in double precision, so scores carry no error; only abandoned or unprobed ones may be
missed. Lists are probed until they hold more than k other vectors, ``probes`` at least.

Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part; nor
do rows without vec_id. Equal scores go to the smaller vec_id. Rows that repeat a vec_id are rows of their own: each is
a query and a candidate of the others, never of itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, tidy

K = 5
EVERY = 50
SAMPLE = 16_384
MOST_LISTS = 1024
PROBE_SHARE = 0.75
LEAST_PROBES = 32
#: Lists that are scanned before the others.
FIRST_PROBES = 4
BLOCK = 2048
GROUP = 256
WIDTH = 8
EPSILON = 1.2
SEED = 7


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (the vectors that take part, in double precision), and their length.

    Vectors with components whose squares overflow or vanish are scaled by a power of two, which changes no cosine.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(F.greatest(s, F.abs(x))))
    ok = ok.withColumn("size", size).where("size > 0 and size < double('infinity')")
    sizes = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    power = F.when((F.col("size") > 1e100) | (F.col("size") < 1e-100), F.floor(F.log2("size")).cast("int")).otherwise(0)
    half = (F.col("power") / 2).cast("int")  # in two steps: a power of two itself may overflow
    ok = ok.where(F.size("v") == d).withColumn("power", power)
    scaled = F.transform("v", lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.col("power")))
    return ok.select("vec_id", F.when(F.col("power") == 0, F.col("v")).otherwise(scaled).alias("v")), d


def train(points: DataFrame, d: int, n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and centres (in rotated space)."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    got = points.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("v").toPandas()  # SAMPLE rows at most
    x = np.array(got["v"].tolist(), np.float64).reshape(-1, d)
    x = _unit(x) @ rotation
    lists = int(min(MOST_LISTS, max(1, round(n**0.5)), len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return rotation, centres


def build(points: DataFrame, rotation: np.ndarray, centres: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The blocks (list, n, rows, ids, columns, raw) and the lists' sizes."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((rotation, centres))  # at most MOST_LISTS rows

    def assign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, mid = shared.value
        for batch in source:
            if batch.num_rows:
                own = np.argmax(_unit(_matrix(batch.column("v"))) @ turn @ mid.T, axis=1)
                yield batch.append_column("list", pa.array(own.astype(np.int32)))

    placed = materialize(points.mapInArrow(assign, "row long, vec_id long, v array<double>, list int"), "nn-placed")
    counts = placed.groupBy("list").count().collect()  # at most MOST_LISTS rows
    sizes = np.zeros(len(centres), np.int64)
    for r in counts:
        sizes[r["list"]] = r["count"]
    parts = F.element_at(F.array(*[F.lit(int(-(-s // BLOCK)) or 1) for s in sizes]), F.col("list") + 1)
    keyed = placed.withColumn("part", F.pmod(F.xxhash64("row"), parts))

    def block(table: pa.Table) -> pa.Table:
        turn, _ = shared.value
        raw = _matrix(table.column("v").combine_chunks())
        x = (_unit(raw) @ turn).astype(np.float32)
        columns = [np.ascontiguousarray(x[:, k : k + WIDTH].T) for k in range(0, x.shape[1], WIDTH)]
        numbers = {c: pa.array([table.column(n).to_numpy().astype("<i8").tobytes()], pa.binary()) for c, n in (("rows", "row"), ("ids", "vec_id"))}
        return pa.table(
            {
                "list": table.column("list")[:1],
                "n": pa.array([len(raw)], pa.int32()),
                **numbers,
                "columns": pa.array([b"".join(c.tobytes() for c in columns)], pa.binary()),
                "raw": pa.array([raw.tobytes()], pa.binary()),
            }
        )

    blocks = keyed.groupBy("list", "part").applyInArrow(block, "list int, n int, rows binary, ids binary, columns binary, raw binary")
    return materialize(blocks, "nn-blocks"), sizes


def scan_block(q: np.ndarray, rows_q: np.ndarray, bound: np.ndarray, turned: np.ndarray, rows: np.ndarray, ids: np.ndarray, columns: list[np.ndarray], raw: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The best k of a block for each query: the query's row, vector, cosine. ``bound``: squared distances already reached."""
    n, d = len(rows), turned.shape[1]
    norms = np.linalg.norm(raw, axis=1)
    # a bound for each query from the first candidates too, all their dimensions
    first = min(n, max(4 * k, 64))
    start = sum((((c[:, :first].T[None] - turned[:, None, a : a + WIDTH]) ** 2).sum(-1) for a, c in zip(range(0, d, WIDTH), columns, strict=True)), np.zeros((len(q), first), np.float32))
    start[rows[None, :first] == rows_q[:, None]] = np.inf
    if first >= k:
        bound = np.minimum(bound, np.partition(start, k - 1, axis=1)[:, k - 1])
    c0 = columns[0]
    part = (c0**2).sum(0)[None] + (turned[:, :WIDTH] ** 2).sum(1)[:, None] - 2 * turned[:, :WIDTH] @ c0
    out = []
    for i in range(len(q)):
        live = np.flatnonzero(rows != rows_q[i])
        so_far = part[i, live]
        for b, c in enumerate(columns):
            seen = min((b + 1) * WIDTH, d)
            if b:
                so_far = so_far + ((c[:, live] - turned[i, b * WIDTH : seen, None]) ** 2).sum(0)
            slack = 1.0 if seen == d else (1 + EPSILON / seen**0.5) ** 2
            keep = so_far * (d / seen) <= bound[i] * slack + 1e-4
            live, so_far = live[keep], so_far[keep]
        if len(live):
            score = (raw[live] * q[i]).sum(axis=1) / (norms[live] * np.sqrt((q[i] * q[i]).sum()))
            best = np.lexsort((ids[live], -score))[:k]
            out += [(int(rows_q[i]), int(ids[live[j]]), float(score[j])) for j in best]
    return out


def _scan(probed: DataFrame, blocks: DataFrame, rotation: np.ndarray, k: int) -> DataFrame:
    """row, vec_id, score: the best k in each block of a probed list (row, v, bound, list)."""
    spark = probed.sparkSession
    shared = spark.sparkContext.broadcast(rotation)

    def gather(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v").combine_chunks())
        return pa.table(
            {
                "q_list": table.column("list")[:1],
                "q_rows": pa.array([table.column("row").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "q_bound": pa.array([table.column("bound").to_numpy().astype("<f8").tobytes()], pa.binary()),
                "q_raw": pa.array([v.tobytes()], pa.binary()),
            }
        )

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value
        d = len(turn)
        for batch in source:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                q = np.frombuffer(cell["q_raw"]).reshape(-1, d)
                turned = (_unit(q) @ turn).astype(np.float32)
                rows, ids, raw, flat = np.frombuffer(cell["rows"], "<i8"), np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["raw"]).reshape(-1, d), np.frombuffer(cell["columns"], np.float32)
                n, columns, at = len(ids), [], 0
                for a in range(0, d, WIDTH):
                    w = min(WIDTH, d - a)
                    columns.append(flat[at : at + w * n].reshape(w, n))
                    at += w * n
                found = scan_block(q, np.frombuffer(cell["q_rows"], "<i8"), np.frombuffer(cell["q_bound"]), turned, rows, ids, columns, raw, k)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["row", "vec_id", "score"])
        tidy()

    counts = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    most = max(counts, default=0)
    parts = F.element_at(F.array(*[F.lit(int(-(-counts.get(i, 0) // GROUP)) or 1) for i in range(most + 1)]), F.col("list") + 1)
    groups = probed.withColumn("part", F.pmod(F.xxhash64("row"), parts)).groupBy("list", "part").applyInArrow(gather, "q_list int, q_rows binary, q_bound binary, q_raw binary")
    met = groups.join(blocks, F.col("q_list") == F.col("list")).select("q_rows", "q_bound", "q_raw", "rows", "ids", "columns", "raw")
    # a cell of the join is a group and a block: dealt evenly, whatever list it is of
    return met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)).mapInArrow(scan, "row long, vec_id long, score double")


def search(queries: DataFrame, rotation: np.ndarray, centres: np.ndarray, blocks: DataFrame, sizes: np.ndarray, k: int = K, share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest lists first, then the others under the bound that these gave."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((rotation, centres, sizes))
    probes = max(LEAST_PROBES, int(np.ceil(share * len(centres))))

    def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, mid, held = shared.value
        for batch in source:
            if not batch.num_rows:
                continue
            near = np.argsort(-(_unit(_matrix(batch.column("v"))) @ turn @ mid.T), axis=1, kind="stable")
            enough = np.minimum(np.maximum(probes, 1 + (np.cumsum(held[near], axis=1) <= k).sum(axis=1)), len(mid))
            row = np.repeat(np.arange(len(near)), enough)
            lists, place = np.concatenate([near[i, :n] for i, n in enumerate(enough)]), np.concatenate([np.arange(n) for n in enough])
            full = held[lists] > 0
            at = pa.array(row[full])
            yield pa.RecordBatch.from_arrays([pa.array(lists[full].astype(np.int32)), pa.array(place[full] < FIRST_PROBES), batch.column("row").take(at), batch.column("v").take(at)], ["list", "first", "row", "v"])

    probed = materialize(queries.select("row", "v").mapInArrow(probe, "list int, first boolean, row long, v array<double>"), "nn-probed")
    nearest_lists = probed.where("first").select("list", "row", "v", F.lit(float("inf")).alias("bound"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = lambda t: t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    early = materialize(best(_scan(nearest_lists, blocks, rotation, k)), "nn-early")
    # the distance of unit vectors at the k-th best cosine so far
    bound = early.where(F.col("rank") == k).select("row", (2 - 2 * F.col("score")).alias("bound"))
    rest = probed.where("not first").join(bound, "row", "left").select("list", "row", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    late = _scan(materialize(rest, "nn-rest"), blocks, rotation, k)
    found = best(early.drop("rank").unionByName(late))
    return found.join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, share: float = PROBE_SHARE) -> DataFrame:
    """The k nearest of all other rows for each row whose vec_id is divisible by ``every``."""
    ship(vectors.sparkSession)
    points, d = valid(vectors.select("vec_id", "embedding"))
    points = materialize(points.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "nn-points")
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotation, centres = train(points, d, n)
    blocks, sizes = build(points, rotation, centres)
    return search(points.where(F.col("vec_id") % every == 0), rotation, centres, blocks, sizes, k, share)
