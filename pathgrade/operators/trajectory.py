"""Five layers of a trajectory's score, their weighted total, and how much scores vary between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def layers(steps: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Steps (step_index, n_steps, action, scenario) -> intent, planning, tool_calls, recovery (null: none), outcome, and ``more`` aggregates.

    One aggregation by the trajectory's keys; partial sums combine before the shuffle.
    """
    before = F.col("step_index") < F.col("n_steps") - 1
    agg = steps.groupBy(*keys).agg(
        F.max("n_steps").alias("n"),
        F.max("scenario").alias("scenario"),
        F.max_by("action", "step_index").alias("final_action"),
        F.sum(((F.col("action") == "") | F.col("action").isin(*K.ACTIONS)).cast("int")).alias("valid"),
        F.min(F.when(before & (F.col("action") == K.ESCALATION), F.col("step_index"))).alias("escalated"),
        F.avg("confidence").alias("mean_confidence"),
        *[c.alias(name) for name, c in more.items()],
    )
    return layered(agg, keys, *more)


def layered(facts: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The layers of trajectories from what their steps come to: n, scenario, final_action, valid and escalated (the first such step before the last)."""
    return facts.select(
        *keys,
        "n",
        "scenario",
        "final_action",
        "mean_confidence",
        F.when(F.col("scenario").isin(*K.SCENARIOS), 0.75).otherwise(0.40).alias("intent"),
        F.when(F.least(F.lit(1.0), 3 / F.greatest(F.lit(1), F.col("n"))) > 0.6, 0.80).otherwise(0.55).alias("planning"),
        (F.col("valid") / F.col("n")).alias("tool_calls"),
        F.when(F.col("n") > 1, 0.70 + 0.30 * (1.0 - F.col("escalated") / (F.col("n") - 1))).alias("recovery"),
        F.when(F.col("final_action").isin(*K.TERMINAL_ACTIONS), 1.0).otherwise(0.0).alias("outcome"),
        *more,
    )


def total(weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the layers that apply, their weights scaled to 1."""
    weights = K.LAYER_WEIGHTS if weights is None else weights
    if missing := set(K.LAYERS) - set(weights):
        raise ValueError(f"weights missing keys: {sorted(missing)}")
    top = sum((F.coalesce(F.col(x), F.lit(0.0)) * weights[x] for x in K.LAYERS), F.lit(0.0))
    return top / sum((F.when(F.col(x).isNotNull(), weights[x]).otherwise(0.0) for x in K.LAYERS), F.lit(0.0))


def projected(scored: DataFrame) -> DataFrame:
    """The dimensions that do not depend on the path: planning, recovery (null: .5), goal, and the tools' precision."""
    return scored.withColumns({"pia_planning": F.col("planning"), "pia_recovery": F.coalesce("recovery", F.lit(0.5)), "pia_goal": (F.col("intent") + F.col("outcome")) / 2, "pia_tools": F.col("tool_calls")})


def variation(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviations over a task's runs (two at least) and the layer that varies most; ties go to the first layer."""
    names = ("intent", "planning", "tool_calls", "recovery", "outcome")
    values = {n: F.coalesce(F.col("recovery"), F.lit(0.5)) if n == "recovery" else F.col(n) for n in names}
    goal = (F.col("intent") + F.col("outcome")) / 2
    agg = scored.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.stddev_samp("total").alias("sd_total"), F.stddev_samp(goal).alias("sd_goal"), *[F.stddev_samp(values[n]).alias(f"sd_{n}") for n in names]
    )
    rounded = [F.round(F.col(f"sd_{n}"), 9) for n in names]
    most = F.greatest(*rounded)
    pick = F.coalesce(*[F.when(r == most, F.lit(n)) for n, r in zip(names, rounded, strict=True)])
    return agg.where(F.col("runs") >= 2).withColumn("most_variable", pick)


def scenario_report(scored: DataFrame) -> DataFrame:
    """Mean total by scenario, and its deviation where there are three runs."""
    return scored.groupBy("scenario").agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"), F.when(F.count("*") >= 3, F.stddev_samp("total")).alias("sd_total"))
