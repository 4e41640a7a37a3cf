"""Scans and sinks over small written files."""

import json

import pytest

from pathgrade.operators import dataset, trajectory
from pathgrade.sources import io


def log(k, scenario, actions):
    steps = [{"step_index": i, "step_name": "plan", "observation": f"o{i}", "reasoning": None, "action": a, "confidence": 0.5} for i, a in enumerate(actions)]
    return {"log_id": f"l{k}", "scenario_type": scenario, "consent_model": "explicit", "trajectory": steps, "ground_truth_action": "send_alert", "context_metadata": {"device_model": "x"}}


@pytest.fixture
def folder(tmp_path):
    logs = [log(0, "health_alert", ["", "send_alert"]), log(1, "ambient_noise", ["", None, "mystery"]), log(2, "health_alert", [])]
    (tmp_path / "logs.jsonl").write_text("".join(json.dumps(x) + "\n" for x in logs))
    deep = tmp_path / "deep" / "er"
    deep.mkdir(parents=True)
    notes = [{"annotation_id": f"a{k}", "log_id": "l0", "persona_name": f"p{k}", "step_quality": k, "privacy_compliance": 1, "goal_alignment": None, "error_recovery": 4} for k in (1, 2)]
    (deep / "notes.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [*notes, {"unrelated": 1}]))
    (deep / "set.json").write_text(json.dumps({"records": [{**notes[0], "annotation_id": "a9"}]}))
    (deep / "list.json").write_text(json.dumps([{**notes[0], "annotation_id": "a10"}]))
    for k in range(3):
        (tmp_path / f"pair_{k}.json").write_text(json.dumps({"pair_id": f"{k}", "scenario": "s"}, indent=1))
    (tmp_path / "scores.json").write_text(json.dumps({"n": 2, "scores": [{"trajectory_id": "a", "weighted_total": 0.5}, {"trajectory_id": "b", "weighted_total": 0.25}]}, indent=1))
    return tmp_path


def test_logs_and_their_steps(spark, folder):
    logs = io.read_jsonl(spark, f"{folder}/logs.jsonl", io.LOG)
    assert [r.log_id for r in dataset.in_order(logs, "log_id", 2).collect()] == ["l0", "l1"]
    steps = io.steps_of(logs)
    assert steps.count() == 5 and steps.where("action = ''").count() == 3
    total = trajectory.layers(steps, ["traj"]).withColumn("total", trajectory.total())
    assert {r.traj: r.outcome for r in total.collect()} == {"l0": 1.0, "l1": 0.0}
    wanted = spark.createDataFrame([("l1",), ("l1",), ("l7",)], "log_id string")
    assert [r.log_id for r in io.only(logs, wanted, "log_id").collect()] == ["l1"]
    with pytest.raises(ValueError):
        dataset.first_n_per_group(logs, "scenario_type", "log_id", 2)
    assert dataset.first_n_per_group(logs.where("scenario_type = 'health_alert'"), "scenario_type", "log_id", 2).count() == 2


def test_broken_lines(spark, folder):
    (folder / "bad.jsonl").write_text('{"log_id": "x"}\n{"log_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, f"{folder}/bad.jsonl", io.LOG).collect()
    assert io.read_jsonl(spark, f"{folder}/bad.jsonl", io.LOG, strict=False).where("log_id is not null").count() == 1


def test_records_wherever_they_lie(spark, folder):
    rows = io.discover(spark, str(folder), io.ANNOTATION, "annotation_id")
    assert sorted(r.annotation_id for r in rows.collect()) == ["a1", "a10", "a2", "a9"]
    assert {r.file.rsplit("/", 1)[1] for r in rows.collect()} == {"notes.jsonl", "set.json", "list.json"}
    long = io.labels_of(rows.where("annotation_id in ('a1', 'a2')"))
    assert long.count() == 8 and long.where("label is null").count() == 2


def test_documents(spark, folder):
    pairs = io.read_files(spark, f"{folder}/pair_*.json", "pair_id STRING, scenario STRING", 3)
    assert sorted(r.pair_id for r in pairs.collect()) == ["0", "1", "2"]
    with pytest.raises(ValueError):
        io.read_files(spark, f"{folder}/pair_*.json", "pair_id STRING", 10)
    scores = io.entries(io.read_documents(spark, f"{folder}/scores.json", "scores ARRAY<STRUCT<trajectory_id: STRING, weighted_total: DOUBLE>>"), "scores")
    assert sorted(map(tuple, scores.collect())) == [("a", 0.5), ("b", 0.25)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "k string, n int, v double")
    io.write_jsonl(rows, f"{tmp_path}/lines")
    io.write_jsonl(rows, f"{tmp_path}/lines", append=True)
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/lines").count() == 4
    io.write_csv(rows, f"{tmp_path}/table")
    assert sorted(r.k for r in spark.read.option("header", True).csv(f"{tmp_path}/table").collect()) == ["a", "b"]
    io.write_parquet(rows, f"{tmp_path}/parts", ["k"])
    assert spark.read.parquet(f"{tmp_path}/parts").where("k = 'a'").first().n == 1
    io.write_report(rows, f"{tmp_path}/report", "entries")
    report = io.read_documents(spark, f"{tmp_path}/report", "n LONG, entries ARRAY<STRUCT<k: STRING, n: INT, v: DOUBLE>>").first()
    assert report.n == 2 and sorted(e.k for e in report.entries) == ["a", "b"]


def test_first_seen_over_files(spark, tmp_path):
    """Duplicates keep the record of the first file by its path's parts, and the first line in it, however files are cut."""
    line = lambda a, who: json.dumps({"annotation_id": a, "persona_name": who, "rationale": "r" * 300}) + "\n"
    files = {
        "top.jsonl": line("x1", "top"),
        "a-b/z.jsonl": line("x1", "a-b") + line("x2", "a-b"),
        "a/m.jsonl": "".join(line(f"m{k % 50}", f"m{k}") for k in range(200)) + line("x2", "a/m") + line("", "no id"),
        "a/n.json": json.dumps({"records": [{"annotation_id": "x3", "persona_name": "n0"}, {"annotation_id": "x3", "persona_name": "n1"}, {"annotation_id": "m7", "persona_name": "n2"}]}),
        "a/o.json": json.dumps([{"annotation_id": "x4", "persona_name": "o0"}, {"annotation_id": "x4", "persona_name": "o1"}, {"annotation_id": None, "persona_name": "o2"}]),
        "b/c/p.jsonl": line("x4", "late") + line("x5", "p") + json.dumps({"unrelated": 1}) + "\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    schema = "annotation_id STRING, persona_name STRING, rationale STRING"
    expected = {f"m{k}": f"m{k}" for k in range(50)} | {"x2": "a/m", "x1": "a-b", "x3": "n0", "x4": "o0", "x5": "p"}
    size = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(size)
    try:
        for most in ("128m", "7k", "1k"):
            spark.conf.set(size, most)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            found = io.discover(spark, str(tmp_path), schema, "annotation_id", below_only=True)
            got = {r.annotation_id: r.persona_name for r in io.first_seen(found.repartition(5), "annotation_id").collect()}
            assert got == expected, most
            every = io.discover(spark, str(tmp_path), schema, "annotation_id")
            assert {r.persona_name for r in every.collect()} >= {"top", "a-b"}
            assert io.first_seen(every, "annotation_id").where("annotation_id = 'x1'").first().file.endswith("a-b/z.jsonl")
    finally:
        spark.conf.set(size, was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
