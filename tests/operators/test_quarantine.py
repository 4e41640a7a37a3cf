import json

import pytest

from pathgrade.operators import quarantine as Q


def log(actions, scenario="health_alert", **more):
    steps = [{"step_index": i, "step_name": "act", "observation": "seen", "action": a, "confidence": 0.9} for i, a in enumerate(actions)]
    return {"scenario_type": scenario, "consent_model": "explicit", "trajectory": steps, "ground_truth_action": "send_alert"} | more


BAD_STEP = log(["", "send_alert"])
BAD_STEP["trajectory"][1]["confidence"] = "high"
ROWS = [
    ("a", json.dumps(log(["", "", "send_alert"]))),
    ("b", json.dumps(log(["", "send_alert"]))[:-4]),
    ("c", json.dumps(log([]))),
    ("d", json.dumps(BAD_STEP)),
    ("e", json.dumps({"scenario_type": "health_alert"})),
    ("f", None),
    ("g", json.dumps(log(["dance"], "ambient_noise"))),
    ("a", json.dumps(log(["", "", "send_alert"]))),
    ("a", json.dumps(log([None], "nowhere"))),
    (None, json.dumps(log(["send_alert"]))),
    ("h", "[]"),
]


@pytest.fixture(scope="module")
def scored(spark):
    return Q.evaluated(spark.createDataFrame([(*r, 1.0) for r in ROWS], "log_id string, record string, total double").repartition(3)).cache()


def test_bad_logs_have_errors_and_no_neighbour_is_lost(scored):
    got = sorted(((r.log_id or "", None if r.error is None else (r.error.stage, r.error.path, r.error.rule)) for r in scored.collect()), key=str)
    assert got == sorted(
        [("a", None), ("a", None), ("a", ("schema", "$.scenario_type", "enum")), ("b", ("parse", "$", "json")), ("c", ("schema", "$.trajectory", "minItems")), ("d", ("schema", "$.trajectory[1].confidence", "type")),
         ("e", ("schema", "$.trajectory", "required")), ("f", ("parse", "$", "json")), ("g", None), ("", None), ("h", ("schema", "$", "type"))], key=str)
    assert all((r.total is None) == (r.error is not None) and (r.overall is None) == (r.error is not None) for r in scored.collect())


def test_scores(scored):
    a = [r for r in scored.collect() if r.log_id == "a" and r.error is None]
    assert len(a) == 2 and a[0] == a[1]
    assert (a[0].n, round(a[0].success, 6), a[0].tool, a[0].leak, a[0].intent, a[0].outcome) == (3, 0.333333, 1.0, False, 0.75, 1.0)
    g = [r for r in scored.collect() if r.log_id == "g"][0]
    assert (g.success, g.tool, g.tool_calls, g.outcome, g.recovery) == (0.0, 0.0, 0.0, 0.0, None)


def test_one_log_alone(spark, scored):
    """A single log has the scores that it has among others."""
    one = Q.scored_one(spark, ROWS[0][1])
    among = [r for r in scored.collect() if r.log_id == "a" and r.error is None][0].asDict(recursive=True)
    assert one == {k: v for k, v in among.items() if k != "log_id"}
    assert Q.scored_one(spark, "{")["error"]["stage"] == "parse"


def test_written_apart(spark, scored, tmp_path):
    Q.write_apart(scored, f"{tmp_path}/good", f"{tmp_path}/bad")
    good, bad = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/bad")
    assert good.count() == 4 and "error" not in good.columns
    assert bad.count() == 7 and {"stage", "path", "rule", "n"} < set(bad.columns)
    assert {(r.path, r.rule): r.n for r in Q.error_counts(scored).collect()}["$", "json"] == 2
    assert {r.path for r in Q.error_counts(scored).collect()} >= {"$.trajectory[].confidence"}


def test_nothing(spark):
    assert Q.evaluated(spark.createDataFrame([], "log_id string, record string")).count() == 0


def test_errors_are_counted_from_one_check(spark):
    """Counting reads the error's stage, path and rule: the record is checked once for them."""
    logs = spark.createDataFrame(ROWS, "log_id string, record string")
    plan = Q.error_counts(Q.examined(logs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("minItems") == 1
    assert {(r.stage, r.path, r.rule): r.n for r in Q.error_counts(Q.examined(logs)).collect()}["parse", "$", "json"] == 2


def test_logs_are_scored_in_their_rows(spark):
    """No exchange; a truth that is missing tells nothing of the last tool, and steps before it are wrong ones."""
    logs = [log(["send_alert", "send_alert"], ground_truth_action=None), log(["send_alert"], ground_truth_action=None), log(["escalate_to_emergency", "dance", "", "send_alert"])]
    rows = Q.evaluated(spark.createDataFrame([(str(k), json.dumps(x)) for k, x in enumerate(logs)], "log_id string, record string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = [(r.n, r.success, round(r.tool, 6), r.tool_calls, r.recovery, r.outcome, r.leak) for r in rows.orderBy("log_id").collect()]
    assert got == [(2, 0.5, 0.0, 1.0, None, 1.0, False), (1, 1.0, 1.0, 1.0, None, 1.0, False), (4, 0.25, 0.333333, 0.75, 1.0, 1.0, False)]
