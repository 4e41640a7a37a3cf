"""Enterprise metrics of trajectories: success, tools, roles, privacy leaks, latency, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def metric_steps(steps: DataFrame, expected: Column) -> DataFrame:
    """Steps as the metrics see them: a tool where there is an action; only the last step has an expected tool and a goal."""
    last = F.col("step_index") == F.col("n_steps") - 1
    tool = F.when(F.col("action") != "", F.col("action"))
    return steps.withColumns({"tool": tool, "expected": F.when(last, F.array(expected)).otherwise(F.array().cast("array<string>")), "goal": last & F.coalesce(tool.isin(*K.TERMINAL_ACTIONS), F.lit(False))})


def success_and_tools(rows: DataFrame, keys: list[str], leak_in: str | None = None) -> DataFrame:
    """success: share of steps with the goal; tool: of the steps with a tool those that were expected (none: 1); leak: whether a text holds personal data."""
    leak = [F.bool_or(T.has_pii(F.col(leak_in))).alias("leak")] if leak_in else []
    return rows.groupBy(*keys).agg(
        F.avg(F.col("goal").cast("double")).alias("success"),
        F.coalesce(F.avg(F.when(F.col("tool").isNotNull(), F.array_contains("expected", F.col("tool")).cast("double"))), F.lit(1.0)).alias("tool"),
        *leak,
    )


def role_correctness(rows: DataFrame, keys: list[str], role: str = "agent_role", expected: str = "expected_role") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.coalesce(F.col(role) == F.col(expected), F.lit(False)).cast("double")).alias("role"))


def latency(ms: Column, sla: float) -> Column:
    """1 within the agreed time, then falling to 0 at twice the time."""
    return F.when(ms <= sla, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (ms - sla) / sla))


def overall(leak: Column) -> Column:
    w = K.METRIC_WEIGHTS
    return w["success"] * F.col("success") + w["tool"] * F.col("tool") + w["grounded"] * F.col("grounded") + w["privacy"] * F.when(leak, 0.0).otherwise(1.0) + w["role"] * F.col("role") + w["latency"] * F.col("latency")


def leaks(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any text of a group has an e-mail address, a US phone number or a social security number."""
    return texts.groupBy(*keys).agg(F.bool_or(T.has_pii(F.col("text"))).alias("leak"), F.sum(T.has_pii(F.col("text")).cast("int")).alias("n_texts"))


def grounded(response: Column, source_words: Column) -> Column:
    """Share of sentences with a word of the sources (no sentences: 1)."""
    return T.sentence_overlap(response, source_words)


def facts(response: Column, source_words: Column) -> Column:
    """Mean of the judge's constant, the overlap and the offline grounding."""
    return (F.lit(K.JUDGE_OFFLINE) + grounded(response, source_words) + F.lit(K.GROUNDED_OFFLINE)) / 3


def eligibility(n_steps: Column, final_action: Column, truth: Column) -> Column:
    """0 without steps or final action; .5 without a truth; else whether they agree."""
    return F.when((n_steps == 0) | (F.coalesce(final_action, F.lit("")) == ""), 0.0).when(F.coalesce(truth, F.lit("")) == "", 0.5).when(final_action == truth, 1.0).otherwise(0.0)


def gate_facts(grounding: Column, eligible: Column) -> Column:
    return F.when(eligible > 0, grounding).otherwise(0.0)
