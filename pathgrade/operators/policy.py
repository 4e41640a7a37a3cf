"""What agents decide: consent, vital signs, noise; one agent against several; who answers for a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _has(words: tuple[str, ...], keywords: str = "keywords") -> Column:
    return F.arrays_overlap(F.col(keywords), F.array(*[F.lit(w) for w in words]))


def _choice(action: str, confidence: float) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(confidence).alias("confidence"))


def vital_signs(alert: float = 0.85, emergency: float = 0.95, calm: float = 0.78) -> Column:
    hr, ox = F.col("heart_rate"), F.col("spo2")
    critical = (hr > K.HEART_RATE[1]) | (ox < K.SPO2[1])
    return (
        F.when(critical & _has(K.EMERGENCY_WORDS), _choice("escalate_to_emergency", emergency))
        .when((hr > K.HEART_RATE[0]) | (ox < K.SPO2[0]), _choice("send_alert", alert))
        .otherwise(_choice("log_and_monitor", calm))
    )


def noise() -> Column:
    return F.when(F.col("noise_db") > K.LOUD_DB, _choice("adjust_noise_profile", 0.90)).otherwise(_choice("adjust_noise_profile", 0.80))


def consent_rule() -> Column:
    return (
        F.when(F.col("consent") == "revoked", _choice("suppress_capture", 0.99))
        .when((F.col("consent") == "ambient") & _has(K.SENSITIVE_WORDS), _choice("request_consent", 0.87))
        .when(F.col("scenario") == "location_trigger", _choice("trigger_geofence", 0.88))
        .otherwise(_choice("suppress_capture", 0.82))
    )


def several_agents(logs: DataFrame) -> DataFrame:
    """The orchestrator's route by scenario, the specialist's choice, and the handoff's quality."""
    s = F.col("scenario")
    route = F.when(s.isin("health_alert", "ambient_noise"), "health_check").when(s.isin("privacy_sensitive", "location_trigger"), "privacy_check").otherwise("action_step")
    choice = (
        F.when(s == "ambient_noise", noise()).when(s == "health_alert", vital_signs()).when(s.isin("privacy_sensitive", "location_trigger"), consent_rule()).otherwise(_choice("surface_reminder", 0.92))
    )
    handoff = F.when(s.isin("health_alert", "privacy_sensitive", "location_trigger"), 5).otherwise(4)
    return logs.withColumn("choice", choice).withColumns({"route": route, "multi_action": F.col("choice.action"), "multi_confidence": F.col("choice.confidence"), "handoff_quality": handoff}).drop("choice")


def as_steps(routed: DataFrame, keys: list[str]) -> DataFrame:
    """Several agents' decision as three steps: the orchestrator, the specialist, the action."""
    step = lambda k, node, action: F.struct(F.lit(k).alias("step_index"), node.alias("node"), action.alias("action"))
    steps = F.array(step(0, F.lit("orchestrate"), F.lit("")), step(1, F.col("route"), F.lit("")), step(2, F.lit("act"), F.col("multi_action")))
    return routed.select(*keys, F.inline(steps))


def one_agent(logs: DataFrame) -> DataFrame:
    """The baseline: no specialist for privacy, no look at consent before a geofence."""
    s = F.col("scenario")
    choice = (
        F.when(s == "health_alert", vital_signs(0.87, 0.98, 0.75))
        .when(s == "privacy_sensitive", F.when(F.col("consent") == "revoked", _choice("suppress_capture", 0.95)).otherwise(_choice("log_and_monitor", 0.65)))
        .when(s == "location_trigger", _choice("trigger_geofence", 0.80))
        .when(s == "ambient_noise", F.when(F.col("noise_db") > K.LOUD_DB, _choice("adjust_noise_profile", 0.90)).otherwise(_choice("log_and_monitor", 0.78)))
        .otherwise(_choice("surface_reminder", 0.92))
    )
    return logs.withColumn("choice", choice).withColumns({"single_action": F.col("choice.action"), "single_confidence": F.col("choice.confidence")}).drop("choice")


def compliant(action: Column) -> Column:
    """Whether an action honours the consent."""
    return (
        F.when(F.col("consent") == "revoked", action == "suppress_capture")
        .when((F.col("consent") == "ambient") & _has(K.SENSITIVE_WORDS), action.isin("suppress_capture", "request_consent"))
        .otherwise(F.lit(True))
    )


def capture_gate(enabled: bool = True) -> Column:
    """blocked, reason."""
    c = F.col("consent")
    row = lambda blocked, reason: F.struct(F.lit(blocked).alias("blocked"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    if not enabled:
        return row(False, "gate disabled")
    return (
        F.when(c == "revoked", row(True, "revoked"))
        .when((F.col("scenario") == "privacy_sensitive") & (c == "ambient"), row(True, "ambient consent in a private setting"))
        .when(c == "ambient", row(False, "ambient: less trust"))
        .otherwise(row(False, F.concat(F.lit("consent: "), c)))
    )


def compliance_suggestion(action: Column, consent: Column) -> Column:
    """label, score: a guess that an annotator confirms."""
    row = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
    return (
        F.when(action == "", row("compliant", 0.95))
        .when((consent == "revoked") & ~action.isin("suppress_capture", "request_consent"), row("non_compliant", 0.95))
        .when((consent == "ambient") & action.isin("log_and_monitor", "trigger_geofence"), row("non_compliant", 0.80))
        .otherwise(row("compliant", 0.70))
    )


def winner(a: Column, b: Column, first: str, second: str, tolerance: float = 1e-6) -> Column:
    return F.when(a - b > tolerance, first).when(b - a > tolerance, second).otherwise("tie")


def attribution(roles: DataFrame, keys: list[str], goal: str = "goal_achieved") -> DataFrame:
    """Who kept to their authority and who answers for a failure; a run without roles has no row."""
    agg = roles.groupBy(*keys).agg(
        F.count("*").alias("n_roles"),
        F.avg(F.col("authority_appropriate").cast("double")).alias("authority_rate"),
        F.avg("delegation_quality").alias("mean_delegation"),
        F.bool_or("accountability_clear").alias("accountable"),
        F.bool_or(goal).alias("goal"),
        F.min_by("handoff_quality", F.when(F.col("agent_role") == "orchestrator", F.col("pos"))).alias("handoff"),
    )
    return agg.withColumns({"coverage": F.when(F.col("goal") | F.col("accountable"), 1.0).otherwise(0.0), "cascade_risk": ~F.col("goal") & ~F.col("accountable")}).drop("accountable")
