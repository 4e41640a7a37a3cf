"""Process rewards of steps, credit, and conflicts between process and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT_TOOLS = ("send_alert", "escalate_to_emergency")


def process_reward(action: Column, index: Column, success: Column, quality: Column | None = None) -> Column:
    """An alert that led to success: 1; nothing done before a failure: -1; else the rated quality; else by the place."""
    out = F.when(action.isin(*ALERT_TOOLS) & success, 1.0).when((action == "no_action") & ~success, -1.0)
    if quality is not None:
        out = out.when(quality.isNotNull(), (quality - 2.5) / 1.5)
    return out.otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.3 - 0.25 * index)))


def step_rewards(steps: DataFrame, success: str = "success", quality: str | None = None) -> DataFrame:
    last = F.col("step_index") == F.col("n_steps") - 1
    out = steps.withColumn("is_terminal", last)
    out = out.withColumn("process_reward", process_reward(F.col("action"), F.col("step_index"), F.col(success), F.col(quality) if quality else None))
    out = out.withColumn("outcome_reward", F.when(~last, 0.0).when(F.col(success), 1.0).otherwise(-1.0))
    return out.withColumn("partial_credit", F.when(last, (F.col("process_reward") + 1) / 2).otherwise(F.greatest(F.lit(0.0), F.col("process_reward"))))


def conflicts(rewarded: DataFrame, keys: list[str], success: str = "success") -> DataFrame:
    """conflict: the end failed, and at least half of the steps before it had a positive reward."""
    inner = ~F.col("is_terminal")
    agg = rewarded.groupBy(*keys).agg(
        F.max((~F.col(success)).cast("int")).alias("failed"),
        F.avg(F.when(inner, (F.col("process_reward") > 0).cast("double"))).alias("positive"),
        F.sum(F.when(inner, F.col("process_reward"))).alias("sum_reward"),
        F.sum(F.when(inner, F.col("partial_credit"))).alias("sum_credit"),
        F.sum(inner.cast("int")).alias("n_inner"),
    )
    return agg.withColumn("conflict", (F.col("failed") == 1) & (F.coalesce("positive", F.lit(0.0)) >= 0.5))


def reward_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("n"),
        F.sum(F.col("conflict").cast("int")).alias("n_conflict"),
        F.sum("failed").alias("n_failed"),
        (F.sum("sum_reward") / F.sum("n_inner")).alias("mean_reward"),
        (F.sum("sum_credit") / F.sum("n_inner")).alias("mean_credit"),
    )
