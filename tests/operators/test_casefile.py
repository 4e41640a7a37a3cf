import pytest

from pathgrade.operators import casefile

STEPS = "log string, step_index long, observation string, action string, confidence double"
LOGS = "log string, scenario string, consent string"


@pytest.fixture(scope="module")
def cases(spark):
    steps = [
        ("a", 0, "Heart rate high. Steps low", "", 0.95),
        ("a", 1, "user resting", "", 0.55),
        ("a", 2, "heart calm. nothing new! rate", "escalate_to_emergency", 0.9),
        ("b", 0, "alone here. no source", "search", 0.9),
        ("c", 1, "unseen words", "", 0.9),
        ("c", 0, None, "", None),
        ("d", 0, "x", "send_alert", 0.8),
        ("d", 1, "BPM is fine. x.", "log", 0.65),
    ]
    logs = [("a", "health_alert", "explicit"), ("b", "privacy_sensitive", "ambient"), ("c", "ambient_noise", "ambient"), ("d", "health_alert", "revoked"), ("e", "health_alert", "implied")]
    args = spark.createDataFrame(steps, STEPS).repartition(3), spark.createDataFrame(logs, LOGS), ["log"]
    return {on: {r.log: r for r in casefile.case_files(*args, gate_enabled=on).collect()} for on in (True, False)}


def test_grounding_in_earlier_observations(cases):
    """Two of three sentences; a lone observation grounds itself; nothing in common; one of two; no steps."""
    assert {k: round(r.facts.search, 6) for k, r in cases[True].items()} == {"a": 0.666667, "b": 1.0, "c": 0.0, "d": 0.5, "e": 1.0}
    assert all(abs(r.facts.overall - (0.7 + r.facts.search + 0.75) / 3) < 1e-12 for r in cases[True].values())


def test_triggers_see_the_actions_as_they_are(cases):
    fired = {k: [(t.step_index, t.trigger_type, t.severity) for t in r.fired] for k, r in cases[True].items()}
    assert fired["a"] == [(0, "domain_expertise_required", "high"), (1, "confidence_below_threshold", "high"), (2, "safety_adjacent_action", "critical")]
    assert fired["b"] == [] == fired["c"] == fired["e"]
    assert fired["d"] == [(0, "safety_adjacent_action", "medium"), (1, "domain_expertise_required", "high")]
    assert {k: (r.hitl_count, r.hitl_triggered) for k, r in cases[True].items()} == {"a": (3, True), "b": (0, False), "c": (0, False), "d": (2, True), "e": (0, False)}


def test_gate(cases):
    assert {k: r.blocked for k, r in cases[True].items()} == {"a": False, "b": True, "c": False, "d": True, "e": False}
    assert all(r.reason for r in cases[True].values())
    assert not any(r.blocked for r in cases[False].values()) and {r.reason for r in cases[False].values()} == {"gate disabled"}
