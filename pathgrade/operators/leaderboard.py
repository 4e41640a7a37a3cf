"""Frameworks against each other: chains of tools, means, six rankings, one composite rank, a gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K


def cascade_depth(steps: DataFrame, keys: list[str], tool: Column, order: str = "step_index") -> DataFrame:
    """The longest run of steps with a tool in a row: islands between gaps."""
    own = Window.partitionBy(*keys).orderBy(order)
    flag = steps.select(*keys, F.col(order), F.coalesce(tool, F.lit(False)).alias("t"))
    island = flag.withColumn("g", F.sum((~F.col("t")).cast("int")).over(own)).groupBy(*keys, "g").agg(F.sum(F.col("t").cast("int")).alias("run"))
    return island.groupBy(*keys).agg(F.max("run").alias("cascade_depth"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Means by framework; no score counts as 0, no deviation is left out."""
    return runs.groupBy("framework").agg(
        F.avg(F.coalesce("trajectory_score", F.lit(0.0))).alias("avg_trajectory_score"),
        F.avg("tokens_used").alias("avg_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg(F.col("goal_achieved").cast("double")).alias("goal_achievement_rate"),
        F.coalesce(F.avg("nondeterminism_variance"), F.lit(0.0)).alias("avg_nondeterminism_variance"),
        F.avg(F.col("cascade_depth").cast("double")).alias("avg_cascade_depth"),
    )


def with_deviation(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each run with the sample deviation of its task and framework, where there are two runs.

    Few keys hold many runs, so deviations are aggregated (partial sums combine first) and joined back, not windowed.
    """
    own = [f"__{k}" for k in keys]
    spread = runs.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]).agg(F.stddev_samp("trajectory_score").alias("nondeterminism_variance"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)))
    return runs.join(spread, same, "left").drop(*own)


def ordinal(framework: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in K.FRAMEWORKS]), framework)


def rankings(board: DataFrame) -> DataFrame:
    """pos_<metric> for each ranking; equal values keep the frameworks' order. A row for each framework."""
    out = board
    for metric, low in K.RANKED:
        value = F.round(F.col(metric), 9)
        out = out.withColumn(f"pos_{metric}", F.row_number().over(Window.orderBy(value.asc() if low else value.desc(), ordinal(F.col("framework")))))
    return out


def composite(ranked: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, (F.col(f"pos_{m}") for m, _ in K.RANKED))
    out = ranked.withColumn("rank_sum", total)
    return out.withColumn("overall_rank", F.row_number().over(Window.orderBy("rank_sum", ordinal(F.col("framework")))))


def gate(rows: DataFrame, limits: dict[str, float], keys: list[str]) -> DataFrame:
    """The mean of each metric over the rows that have it, and whether all reach their limits."""
    out = rows.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in limits])
    return out.withColumn("passes", reduce(lambda a, b: a & b, (F.round(F.col(m), 9) >= v for m, v in limits.items())))
