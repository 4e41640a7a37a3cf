"""Rules that annotations must keep, and thresholds that a release must reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def role_rules() -> dict[str, Column]:
    """Rules for role annotations; a null breaks a rule unless the field may be missing."""
    between = lambda c, a, b: F.coalesce(F.col(c).between(a, b), F.lit(False))
    orchestrator = F.col("agent_role") == "orchestrator"
    return {
        "delegation_quality": between("delegation_quality", 1, 5),
        "authority_appropriate": F.col("authority_appropriate").isNotNull(),
        "accountability_clear": F.col("accountability_clear").isNotNull(),
        "handoff_only_from_orchestrator": F.when(orchestrator, between("handoff_quality", 1, 5)).otherwise(F.col("handoff_quality").isNull()),
    }


def step_rules(least_rationale: int = 20) -> dict[str, Column]:
    within = lambda c, a, b: F.coalesce(F.col(c).between(a, b), F.lit(False))
    return {
        "process_reward": within("process_reward", -1.0, 1.0),
        "partial_credit": within("partial_credit", 0.0, 1.0),
        "rationale": F.coalesce(F.length("rationale") >= least_rationale, F.lit(False)),
    }


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, checked, broken: one pass over the rows for all rules."""
    counts = rows.agg(F.count("*").alias("__n"), *[F.sum((~ok).cast("long")).alias(name) for name, ok in rules.items()])
    return counts.unpivot(["__n"], list(rules), "rule", "broken").select("rule", F.col("__n").alias("checked"), F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


def invalid(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, and which."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def reached(means: DataFrame, spec: str) -> DataFrame:
    """metric, mean, least, passes for the thresholds in ``spec`` ('k=v,k=v'), and a row 'all'. A metric without a mean has 0.

    ``means`` is one row; thresholds name its columns.
    """
    if not spec.strip() or any("=" not in part for part in spec.split(",")):
        raise ValueError(f"thresholds must be k=v,k=v: {spec!r}")
    limits = T.thresholds(F.lit(spec))
    names = [part.split("=")[0].strip() for part in spec.split(",")]
    of = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in means.columns else F.lit(0.0)
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(of(n), 9).alias("mean"), limits[n].alias("least")) for n in names])
    each = means.select(rows.alias("r")).withColumn("passes", F.forall("r", lambda x: x["mean"] >= x["least"]))
    every = F.array(F.struct(F.lit("all").alias("metric"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("least")))
    out = each.select(F.explode(F.concat("r", every)).alias("x"), "passes").select("x.*", F.col("passes").alias("__all"))
    return out.select("metric", "mean", "least", F.when(F.col("metric") == "all", F.col("__all")).otherwise(F.col("mean") >= F.col("least")).alias("passes"))


def weighted_within(rows: DataFrame, weights: dict[str, float], latency: dict[str, str], sla: float) -> Column:
    """The weighted sum of metrics of which each counts only if its own latency is within the agreed time."""
    return reduce(lambda a, b: a + b, (F.lit(w) * F.col(m) * F.coalesce((F.col(latency[m]) <= sla).cast("double"), F.lit(0.0)) for m, w in weights.items()))
