"""Tables laid out for what reads them: steps bucketed by trajectory, runs that may be written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(rows: DataFrame, table: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """A table bucketed by ``keys`` and sorted within buckets, one file each: aggregates, windows and joins by the keys read
    it without an exchange. ``buckets`` is best a multiple of the cores and such that a bucket's rows fit a task."""
    dealt = rows.repartition(buckets, *[F.col(k) for k in keys])
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def append_run(rows: DataFrame, path: str, run_id: str, fmt: str = "json", by: str = "run") -> None:
    """Append a run's rows; writing the same run again replaces its rows and leaves those of other runs.

    Each run is a partition of its own, and only the partitions that are written are overwritten. A run without rows
    replaces nothing.
    """
    out = rows.withColumn(by, F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(fmt).save(path)


def read_runs(like: DataFrame, path: str, fmt: str = "json", by: str = "run") -> DataFrame:
    """What append_run has written, with the columns of ``like``."""
    schema = like.drop(by).schema.add(by, "string")
    return like.sparkSession.read.schema(schema).format(fmt).load(path)
