"""When a human must look at a step: low confidence, safety words, unknown tools, expert domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def with_trigger(steps: DataFrame, confidence: str = "confidence", action: str = "action", output: str | None = None, tools: str | None = None, threshold: float = 0.70) -> DataFrame:
    """Adds trigger_type, severity, domain: the most severe check that fires, the first of equals. Works on streams too."""
    act = F.lower(F.coalesce(F.col(action), F.lit("")))
    conf = F.coalesce(F.col(confidence), F.lit(1.0))
    said = F.concat(act, F.lit(" "), F.lower(F.coalesce(F.col(output), F.lit("")))) if output else act
    used = F.col(tools) if tools else F.when(act != "", F.array(F.col(action))).otherwise(F.array().cast("array<string>"))
    s1 = F.when(conf < 0.5, 3).when(conf < 0.6, 2).when(conf < threshold, 1)
    s2 = F.when(_any(act, K.SAFETY_KEYWORDS), F.when(_any(act, K.CRITICAL_SAFETY), 3).when(_any(act, K.HIGH_SAFETY), 2).otherwise(1))
    known = F.array(*[F.lit(t) for t in K.KNOWN_TOOLS])
    s3 = F.when(F.size(F.array_except(used, known)) > 0, 1)
    domain = reduce(lambda out, kv: out.when(_any(said, kv[1]), kv[0]), list(K.DOMAIN_KEYWORDS.items())[1:], F.when(_any(said, K.DOMAIN_KEYWORDS["medical"]), "medical"))
    s4 = F.when(domain.isin("medical", "legal"), 2).when(domain.isNotNull(), 1)
    most = F.greatest(*[F.coalesce(s, F.lit(-1)) for s in (s1, s2, s3, s4)])
    kind = F.coalesce(*[F.when(s == most, F.lit(t)) for s, t in zip((s1, s2, s3, s4), K.TRIGGERS, strict=True)])
    names = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    return steps.withColumns({"trigger_type": kind, "severity": names[most], "domain": F.when(kind == K.TRIGGERS[3], domain)})


def trigger_summary(triggered: DataFrame) -> DataFrame:
    """Counts of every type (0 too) and severity, and triggers for each step."""
    aggs = [F.sum((F.col("trigger_type") == t).cast("int")).alias(t) for t in K.TRIGGERS]
    out = triggered.agg(
        F.count("trigger_type").alias("n_triggers"),
        *aggs,
        F.sum((F.col("severity") == "critical").cast("int")).alias("critical"),
        F.sum((F.col("severity") == "high").cast("int")).alias("high"),
        (F.count("trigger_type") / F.count("*")).alias("rate"),
    )
    return out.fillna(0)
