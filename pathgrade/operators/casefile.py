"""A log's whole case in one row: may it be captured, is its end grounded in what came before, who must look at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import policy, triggers


def grounding(observations: Column) -> Column:
    """parametric, search, grounding, overall of the last observation, against those before it; a lone one against itself.

    The parts that a model would judge are the constants of a run without one.
    """
    last = F.coalesce(F.element_at(observations, -1), F.lit(""))
    before = F.slice(observations, 1, F.greatest(F.size(observations) - 1, F.lit(0)))
    sources = F.when(F.size(before) > 0, F.array_join(before, " ")).otherwise(last)
    search = F.when(F.size(observations) == 0, 1.0).otherwise(T.sentence_overlap(last, T.word_set(sources)))
    parametric, judged = F.lit(K.JUDGE_OFFLINE), F.lit(K.GROUNDED_OFFLINE)
    return F.struct(parametric.alias("parametric"), search.alias("search"), judged.alias("grounding"), ((parametric + search + judged) / 3).alias("overall"))


def reviews(steps: DataFrame, keys: list[str]) -> DataFrame:
    """By log: observations in order, fired (an array of step_index, trigger_type, severity), their number."""
    marked = triggers.with_trigger(steps, output="observation")
    fired = F.when(F.col("trigger_type").isNotNull(), F.struct("step_index", "trigger_type", "severity"))
    rows = F.array_sort(F.collect_list(F.struct("step_index", F.coalesce("observation", F.lit("")).alias("seen"), fired.alias("fired"))))
    out = marked.groupBy(*keys).agg(rows.alias("rows"))
    return out.select(*keys, F.col("rows.seen").alias("observations"), F.filter(F.col("rows.fired"), lambda x: x.isNotNull()).alias("fired"))


def case_files(steps: DataFrame, logs: DataFrame, keys: list[str], gate_enabled: bool = True) -> DataFrame:
    """``logs`` (keys, scenario, consent, more) with blocked, reason, facts, fired, hitl_count, hitl_triggered.

    ``steps``: keys, step_index, observation, action, confidence. A log without steps has no triggers and is grounded.
    """
    none = F.array().cast("array<struct<step_index:int,trigger_type:string,severity:string>>")
    rows = logs.join(reviews(steps.withColumn("step_index", F.col("step_index").cast("int")), keys), keys, "left")
    rows = rows.withColumns({"observations": F.coalesce("observations", F.array().cast("array<string>")), "fired": F.coalesce("fired", none)})
    gate = policy.capture_gate(gate_enabled)
    rows = rows.withColumns({"blocked": gate["blocked"], "reason": gate["reason"], "facts": grounding(F.col("observations")), "hitl_count": F.size("fired")})
    return rows.withColumn("hitl_triggered", F.col("hitl_count") > 0).drop("observations")
