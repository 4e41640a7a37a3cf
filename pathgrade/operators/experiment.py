"""A/B experiments: split by rank, damage one side, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 50


def split(scored: DataFrame, score: str, key: str, n: int = GROUP) -> DataFrame:
    """The n best (by score, then key) are curated, all rows after them raw; fewer than 2 n rows are an error.

    The best are found by a top-n, so nothing is sorted as a whole.
    """
    if scored.limit(2 * n).count() < 2 * n:
        raise ValueError(f"an experiment needs at least {2 * n} scored rows")
    best = scored.orderBy(F.round(F.col(score), 9).desc(), key).limit(n).select(F.col(key).alias("__key"))
    rows = scored.join(F.broadcast(best), F.col(key) == F.col("__key"), "left")  # n rows
    return rows.withColumn("grp", F.when(F.col("__key").isNotNull(), "curated").otherwise("raw")).drop("__key")


def damage(rows: DataFrame, where: Column, columns: dict[str, Column]) -> DataFrame:
    """Overwrite columns of the rows that a coin chose."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in columns.items()})


def metric_table(rows: DataFrame, metrics: list[str], group: str = "grp") -> DataFrame:
    """group, metric, mean, sd (one row: 0)."""
    long = rows.select(group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("z"))
    return long.groupBy(group, "z.metric").agg(F.avg("z.v").alias("mean"), F.coalesce(F.stddev_samp("z.v"), F.lit(0.0)).alias("sd"))


def delta(table: DataFrame, base: str = "raw", other: str = "curated", group: str = "grp") -> DataFrame:
    """metric, base, other, delta, percent (base 0: 0)."""
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("mean")))
    out = table.groupBy("metric").agg(side(base).alias("base"), side(other).alias("other"))
    change = F.col("other") - F.col("base")
    return out.select("metric", "base", "other", change.alias("delta"), F.when(F.col("base") == 0, 0.0).otherwise(100 * change / F.col("base")).alias("percent"))
