import pytest
from pyspark.sql import functions as F

from pathgrade.operators import leaderboard, metrics, policy, privacy, rewards, trajectory, triggers
from pathgrade.functions import text as T


def steps(spark, runs, scenario="health_alert"):
    rows = [(t, i, len(acts), a, scenario, 0.9) for t, acts in runs.items() for i, a in enumerate(acts)]
    return spark.createDataFrame(rows, "traj string, step_index long, n_steps long, action string, scenario string, confidence double")


def test_layers_and_total(spark):
    runs = {"good": ["", "", "send_alert"], "long": ["", "", "", "", "send_alert"], "early": ["escalate_to_emergency", "", "send_alert"], "late": ["", "escalate_to_emergency", "no_such_tool"]}
    got = {r.traj: r for r in trajectory.layers(steps(spark, runs), ["traj"]).withColumn("total", trajectory.total()).collect()}
    assert abs(got["good"].total - 0.7625 / 0.85) < 1e-9 and got["good"].recovery is None
    assert abs(got["long"].total - 0.823529) < 1e-6 and got["long"].planning == 0.55
    assert got["early"].recovery == 1.0 and abs(got["late"].recovery - 0.85) < 1e-12
    assert abs(got["late"].tool_calls - 2 / 3) < 1e-12 and got["late"].outcome == 0
    with pytest.raises(ValueError):
        trajectory.total({"intent": 1.0})


def test_rewards(spark):
    s = steps(spark, {"x": ["", "", "log_and_monitor"]}).withColumn("success", F.lit(False))
    rows = rewards.step_rewards(s).orderBy("step_index").collect()
    assert [round(r.process_reward, 9) for r in rows] == [0.3, 0.05, -0.2]
    assert [round(r.partial_credit, 9) for r in rows] == [0.3, 0.05, 0.4] and [r.outcome_reward for r in rows] == [0, 0, -1]
    assert rewards.conflicts(rewards.step_rewards(s), ["traj"]).first().conflict


def test_triggers(spark):
    s = steps(spark, {"x": ["delete_all", "log", "escalate_to_emergency", "strange", ""]}).withColumn("confidence", F.when(F.col("step_index") == 1, 0.55).otherwise(0.9)).withColumn("output", F.when(F.col("step_index") == 4, "check spo2").otherwise(""))
    rows = triggers.with_trigger(s, output="output").orderBy("step_index").collect()
    assert [(r.trigger_type, r.severity) for r in rows] == [("safety_adjacent_action", "high"), ("confidence_below_threshold", "high"), ("safety_adjacent_action", "critical"), ("novel_tool_pattern", "medium"), ("domain_expertise_required", "high")]
    assert rows[4].domain == "medical"


def test_stream_of_triggers(spark, tmp_path):
    from pathgrade.streaming.triggers import triggered

    steps(spark, {"x": ["", "delete", "log"]}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("traj string, step_index long, n_steps long, action string, scenario string, confidence double").parquet(str(tmp_path / "in"))
    q = triggered(stream).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.action for r in spark.table("fired").collect()] == ["delete"]


def test_cascade(spark):
    runs = {"a": ["x", "x", "", "x", "x", "x"], "b": ["", ""], "c": ["x"]}
    got = {r.traj: r.cascade_depth for r in leaderboard.cascade_depth(steps(spark, runs), ["traj"], F.col("action") != "").collect()}
    assert got == {"a": 3, "b": 0, "c": 1}


def test_policies(spark):
    logs = spark.createDataFrame([("health_alert", "explicit", 170.0, 95.0, 50.0, ["help"]), ("health_alert", "explicit", 170.0, 95.0, 50.0, ["x"]), ("location_trigger", "revoked", 80.0, 97.0, 50.0, ["x"]), ("privacy_sensitive", "ambient", 80.0, 97.0, 50.0, ["secret"]), ("ambient_noise", "implied", 80.0, 97.0, 90.0, []), ("calendar_reminder", "implied", 80.0, 97.0, 90.0, [])], "scenario string, consent string, heart_rate double, spo2 double, noise_db double, keywords array<string>")
    rows = policy.one_agent(policy.several_agents(logs)).collect()
    assert [r.multi_action for r in rows] == ["escalate_to_emergency", "send_alert", "suppress_capture", "request_consent", "adjust_noise_profile", "surface_reminder"]
    assert [r.single_action for r in rows][2:4] == ["trigger_geofence", "log_and_monitor"]
    assert [r.b for r in logs.select(policy.capture_gate()["blocked"].alias("b")).collect()] == [False, False, True, True, False, False]


def test_text_and_metrics(spark):
    t = spark.createDataFrame([("Mail a.b@c.org now",), ("call 555-123-4567",), ("123-45-6789",), ("nothing 12",), (None,)], "text string")
    assert [r.p for r in t.select(T.has_pii(F.col("text")).alias("p")).collect()] == [True, True, True, False, False]
    one = spark.createDataFrame([("Heart rate up. All is well! Go?", ["heart", "well"], "")], "a string, w array<string>, e string")
    got = one.select(metrics.grounded(F.col("a"), F.col("w")).alias("x"), metrics.grounded(F.col("e"), F.col("w")).alias("y"), T.topic(F.lit("start a python script")).alias("t"), T.topic(F.lit("zzz")).alias("u")).first()
    assert abs(got.x - 2 / 3) < 1e-12 and got.y == 1.0 and got.t == "coding" and got.u == "general_task"
    ms = spark.createDataFrame([(50.0,), (150.0,), (400.0,)], "m double")
    assert [r.l for r in ms.select(metrics.latency(F.col("m"), 100.0).alias("l")).collect()] == [1.0, 0.5, 0.0]


def test_privacy(spark):
    assert abs(privacy.sigma(10.0, 1.0, 1e-5) - 48.448) < 1e-3
    rows = spark.createDataFrame([(k, "revoked" if k % 2 else "explicit", 70.0, "x") for k in range(2000)], "k long, consent string, heart_rate double, other string")
    got = privacy.sanitise(rows, "k", 1.0, 1e-5)
    free, noisy = got.where("consent = 'revoked'"), got.where("consent = 'explicit'")
    assert free.where("heart_rate <> 70").count() == 0
    s = noisy.agg(F.avg("heart_rate").alias("m"), F.stddev("heart_rate").alias("s")).first()
    assert abs(s.m - 70) < 6 and abs(s.s - 48.4) < 5


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from pathgrade.streaming.triggers import counts

    kinds = "ts timestamp, action string, confidence double"
    first = [("2024-01-01 10:05:00", "search", 0.4), ("2024-01-01 10:50:00", "search", 0.4), ("2024-01-01 10:55:00", "search", 0.9), ("2024-01-01 11:30:00", "delete", 0.9)]
    spark.createDataFrame(first, "ts string, action string, confidence double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    q = counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r.window.start), r.trigger_type): r.n for r in spark.sql("select * from windows").collect()}
    # the last file's time is 11:30, so the hour from 10 is closed and that from 11 is open
    assert got == {("2024-01-01 10:00:00", "confidence_below_threshold"): 2}


def test_routes_and_complete_records(spark):
    from pathgrade.operators import dataset

    logs = spark.createDataFrame([("a", "calendar_reminder", "explicit", 60.0, 99.0, 40.0, ["x"])], "traj string, scenario string, consent string, heart_rate double, spo2 double, noise_db double, keywords array<string>")
    steps = policy.as_steps(policy.several_agents(logs), ["traj"]).orderBy("step_index").collect()
    assert [(r.node, r.action) for r in steps] == [("orchestrate", ""), ("action_step", ""), ("act", "surface_reminder")]
    rows = spark.createDataFrame([("x", 5), ("", 5), (None, 5), ("x", None), ("x", 200)], "text string, n int")
    assert [r.ok for r in rows.select(dataset.is_complete(["text"], {"n": (1, 100)}).alias("ok")).collect()] == [True, False, False, False, False]
