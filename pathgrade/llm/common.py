"""What the training-data operators share: shared folders, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

#: Bytes of a batch between Spark and a Python worker. Texts differ in length, so a number of rows bounds nothing.
ARROW_BYTES = 4 << 20

#: A dimension table of at most this many rows is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 20_000
#: Salts per key of that shuffle.
SALTS = 32

_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let workers import this package, and bound the batches they get (a setting of the session)."""
    shipping.ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark.conf.get(name, None)
    if not (most or "").rstrip("b").isdigit() or int(most.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where it is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="pathgrade-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = f"file://{_own[app]}"
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark)}/pathgrade/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def only_last_stays(spark: SparkSession) -> Iterator[None]:
    """Of the tables that are materialized inside, all but the last are deleted at the end. It must need none of them."""
    _scratch.append([])
    try:
        yield
    finally:
        own = _scratch.pop()
        for path in own[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if own and _scratch:
            _scratch[-1].append(own[-1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column that holds a document's own columns while others stand beside it.
ROW = "__row_of_docs"


def packed_rows(docs: DataFrame) -> tuple[Column, list[str]]:
    """A column with all of a row, so that no name in it can clash, and the names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), docs.columns


def unpacked_rows(rows: DataFrame, names: list[str], *more: Column) -> DataFrame:
    return rows.select(*[F.col(ROW).getField(c).alias(c) for c in names], *more)


def is_small(dim: DataFrame) -> bool:
    """Whether a table may be broadcast."""
    return dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_dimension(df: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", small: bool | None = None) -> DataFrame:
    """Join a table whose keys may be hot to one with a row for each key.

    The dimension is counted, unless a count of its rows or of more is known (``small``). Up to BROADCAST_ROWS rows are
    broadcast; more are repeated SALTS times and joined on the key and a salt, so that a hot key's rows are dealt over
    SALTS tasks. Keys match null-safely.
    """
    on2 = [f"__d_{c}" for c in on]
    small = is_small(dim) if small is None else small
    right = dim.withColumnsRenamed(dict(zip(on, on2, strict=True)))
    cond = [df[a].eqNullSafe(right[b]) for a, b in zip(on, on2, strict=True)]
    if small:
        return df.join(F.broadcast(right), cond, how).drop(*on2)
    left = df.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    right = right.withColumn("__dsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    cond = [left[a].eqNullSafe(right[b]) for a, b in zip(on, on2, strict=True)]
    return left.join(right, [left["__salt"] == right["__dsalt"], *cond], how).drop("__salt", "__dsalt", *on2)


#: A column of numbers of at most so many rows (a few MB) is broadcast.
BROADCAST_IDS = 400_000


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi- or anti-join to a counted column of distinct numbers: broadcast up to BROADCAST_IDS rows, else a shuffle."""
    return df.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, on, how)


#: A key of more rows than this is not left to one task.
UNEVEN_ROWS = 1000


def join_uneven(df: DataFrame, dim: DataFrame, on: list[str], count: str, where: Column) -> DataFrame:
    """Left join of the rows ``where`` to a table with a row for each key and the ``count`` of rows that have it.

    Rows of keys with many rows go through join_dimension, the others through a shuffle on the key. Rows not ``where``
    have nulls in the dimension's columns.
    """
    dim = dim.withColumnRenamed(count, "__count")
    more = [c for c in dim.columns if c not in (*on, "__count")]
    hot = dim.where(F.col("__count") > UNEVEN_ROWS).drop("__count")
    rest = dim.where(F.col("__count") <= UNEVEN_ROWS).drop("__count")
    small = is_small(hot)
    some = df.where(where)
    left = join_dimension(some, hot.select(*on), on, "left_anti", small)
    left = left.join(rest, on, "left").select(*df.columns, *more)
    none = df.where(~where).withColumns({c: F.lit(None).cast(dict(dim.dtypes)[c]) for c in more})
    return left.unionByName(join_dimension(some, hot, on, "inner", small).select(*df.columns, *more)).unionByName(none)


def tidy() -> None:
    """Give the memory that a worker's process has freed back to the system: idle workers stay while other stages run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible uniform number in [0, 1) for a row."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (h.bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))


#: Rows of a small table that one task writes.
ROWS_A_TASK = 200_000


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of (a, b) links: id, component (the smallest id reachable).

    Alternating large-star and small-star steps: each vertex points its larger neighbours, then itself and its
    smaller neighbours, at the smallest one. The minimum of a vertex's neighbours is an aggregate that combines before
    the shuffle and is joined back, so no neighbourhood is gathered in one place. Every step is written to the shared
    folder, in few files where links are few.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = lambda t: t.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b)) x")).first()
    was = mark(cur)
    tasks = was.n // ROWS_A_TASK + 1
    few = tasks < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keep(t: DataFrame) -> DataFrame:
        t = t.where("a <> b").distinct()
        return materialize(t.coalesce(tasks) if few else t, name)

    for _ in range(rounds if was.n else 0):
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large)
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        cur = keep(small)
        now = mark(cur)
        if was == now:
            break
        was = now
    else:
        if was.n:
            raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
