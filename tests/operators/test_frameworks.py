import pytest
from pyspark.sql import functions as F

from pathgrade.functions import text as T
from pathgrade.operators import agreement, facts, frameworks, validity

STEP = "traj string, framework string, step_index int, action string, tool string, tool_calls array<string>, event_kind string, reason string, task_name string, content string, output string, speaker string"


def steps(spark, rows):
    names = [x.split()[0] for x in STEP.split(", ")]
    return spark.createDataFrame([tuple({"traj": "t", "step_index": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], STEP)


def test_own_fields_win(spark):
    rows = [
        {"tool": "search"},
        {"tool": ""},
        {"tool": "a", "tool_calls": ["b"]},
        {"tool": "a", "action": "own"},
        {"event_kind": "handoff"},
        {"event_kind": "handoff", "reason": "why", "task_name": "task"},
        {"task_name": "task", "content": "said", "output": None},
        {"content": "said", "output": "own"},
    ]
    got = [(r.action, r.tool_calls, r.output) for r in frameworks.normalised(steps(spark, rows)).orderBy("step_index").collect()]
    assert got == [("search", ["search"], None), ("", [], None), (None, ["b"], None), ("own", ["a"], None), ("", None, None), ("why", None, None), ("task", None, "said"), (None, None, "own")]


def test_chains_by_framework(spark):
    call = {"tool_calls": ["x"]}
    for framework, rows, want in [
        ("langgraph", [call, call, {}, call], 2),
        ("autogen", [call, {**call, "speaker": "UserProxy"}, call, call, call], 3),
        ("openai_agents", [{"event_kind": "tool_call"}, {"event_kind": "handoff", **call}, {"event_kind": "tool_call"}, {"event_kind": "tool_call"}], 2),
        ("crewai", [{}, {"tool_calls": []}], 0),
    ]:
        got = frameworks.chains(steps(spark, [{**r, "framework": framework} for r in rows]), ["traj"]).first()
        assert got.cascade_depth == want, framework


def test_stand_in(spark):
    runs = spark.createDataFrame([("r", "wearable_privacy", 3, True), ("s", "unknown", 1, False), ("u", "it_helpdesk", 1, True), ("v", "it_helpdesk", 0, True)], "run string, task string, n_steps long, goal_achieved boolean")
    got = [(r.run, r.step_name, r.action, r.scenario) for r in frameworks.stand_in_steps(runs).orderBy("run", "step_index").collect()]
    assert got == [("r", "sense", "", "privacy_sensitive"), ("r", "plan", "", "privacy_sensitive"), ("r", "act", "suppress_capture", "privacy_sensitive"), ("s", "sense", "", "health_alert"), ("u", "act", "send_alert", "calendar_reminder")]


def test_four_digits(spark):
    values = [0.0, 72.0, 98.25, 1234.5, 123456.0, 0.00012345, 1e-05, 100.0, -3.10]
    got = [r.t for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(T.four_digits(F.col("v")).alias("t")).collect()]
    assert got == ["%.4g" % v for v in values]


def test_responses_and_sources(spark):
    rows = [("a", 0, "sense", None, "hr 72"), ("a", 1, None, "because", ""), ("a", 2, "act", "", None), ("b", 0, "x", None, None)]
    got = {r.traj: r for r in facts.step_texts(spark.createDataFrame(rows, "traj string, step_index int, step_name string, reasoning string, observation string"), ["traj"]).collect()}
    assert got["a"].response == "sense: hr 72 step: because" and got["a"].observations == ["hr 72"] and got["b"].response == facts.NO_REASONING
    one = spark.range(1)
    given = facts.sources(F.array(F.lit("o")), {"hr": F.lit(72.5), "x": F.lit(None).cast("double")}, F.lit("s"), {"user": F.lit(3), "model": F.lit(None).cast("string")})
    assert one.select(given.alias("s")).first().s == ["o", "hr=72.5", "user: 3"]
    assert one.select(facts.sources(F.array(F.lit("o")), {"x": F.lit(None).cast("double")}, F.lit("s"), {}).alias("s")).first().s == ["o", "scenario: s"]


def test_rules_and_thresholds(spark):
    rows = spark.createDataFrame([("orchestrator", 3, True, True, 2), ("orchestrator", 9, True, None, None), ("worker", 1, None, False, 4)], "agent_role string, delegation_quality int, authority_appropriate boolean, accountability_clear boolean, handoff_quality int")
    got = {r.rule: (r.checked, r.broken) for r in validity.violations(rows, validity.role_rules()).collect()}
    assert got == {"delegation_quality": (3, 1), "authority_appropriate": (3, 1), "accountability_clear": (3, 1), "handoff_only_from_orchestrator": (3, 2)}
    assert sorted(len(r.broken) for r in validity.invalid(rows, validity.role_rules()).collect()) == [2, 3]
    means = spark.createDataFrame([(0.5, None)], "a double, b double")
    got = {r.metric: (r["mean"], r.passes) for r in validity.reached(means, "a=0.5, b=0.1 ,c=0").collect()}
    assert got == {"a": (0.5, True), "b": (0.0, False), "c": (0.0, True), "all": (None, False)}
    with pytest.raises(ValueError):
        validity.reached(means, "a:0.5")


def test_semantic_agreement(spark):
    left = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 1, [0.0, 1.0]), ("g", 2, [1.0, 1.0])], "grp string, item int, e array<double>")
    right = spark.createDataFrame([("g", 1, [2.0, 0.0]), ("g", 2, [-1.0, -1.0])], "grp string, item int, e array<double>")
    r = agreement.semantic(left, right, ["grp", "item"], "e", "grp").first()
    assert abs(r.p - (1 + 0 - 1) / 3) < 1e-9 and abs(r.r - 0) < 1e-9 and r.band == "weak"
