"""Layouts that save exchanges, and runs that are written twice."""

import pytest
from pyspark.sql import functions as F

from pathgrade.operators import leaderboard, trajectory
from pathgrade.sources import layout


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(f"t{k}", i, 1 + k % 6, ("", "send_alert", "search")[(k + i) % 3], "health_alert", i / 10) for k in range(200) for i in range(1 + k % 6)]
    return spark.createDataFrame(rows, "traj string, step_index int, n_steps int, action string, scenario string, confidence double")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_bucketed_steps_need_no_exchange(spark, steps):
    table = layout.write_bucketed(steps, "bucketed_steps", ["traj"], ["step_index"], 4)
    try:
        assert exchanges(trajectory.layers(steps, ["traj"])) and not exchanges(trajectory.layers(table, ["traj"]))
        tool = F.col("action") != ""
        depth = lambda t: leaderboard.cascade_depth(t, ["traj"], tool)
        assert exchanges(depth(steps)) and not exchanges(depth(table))
        both = trajectory.layers(table, ["traj"]).join(depth(table), "traj")
        assert not exchanges(both)
        key = lambda df: sorted(map(str, df.collect()))
        assert key(both) == key(trajectory.layers(steps, ["traj"]).join(depth(steps), "traj"))
    finally:
        spark.sql("DROP TABLE bucketed_steps")


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_run_that_is_written_twice_is_there_once(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(f"task{k}", k / 2) for k in range(5)], "task string, score double")
    path = f"{tmp_path}/runs"
    layout.append_run(rows, path, "r1", fmt)
    layout.append_run(rows.where("score < 1"), path, "r2", fmt)
    layout.append_run(rows.withColumn("score", F.col("score") + 1), path, "r1", fmt)
    got = sorted((r.run, r.task, r.score) for r in layout.read_runs(rows, path, fmt).collect())
    assert got == sorted([("r1", f"task{k}", k / 2 + 1) for k in range(5)] + [("r2", f"task{k}", k / 2) for k in range(2)])


def test_open_runs_of_a_stream_equal_the_batch(spark, steps, tmp_path):
    """Steps come in any order, some twice; the last row of each trajectory is what the whole table gives."""
    from pathgrade.operators.triggers import with_trigger
    from pathgrade.streaming import open_runs

    source = f"{tmp_path}/in"
    whole = steps.select("traj", "step_index", "action", "confidence")
    some = whole.where("traj < 't15'")
    for k, part in enumerate([some.where("pmod(hash(traj, step_index), 3) = 2"), some.where("pmod(hash(traj, step_index), 3) = 0"), some.where("pmod(hash(traj, step_index), 3) < 2"), spark.createDataFrame([(None, 1, "x", 0.1), ("t0", None, "x", 0.1)], whole.schema)]):
        part.coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = open_runs.open_runs(stream).writeStream.outputMode("update").format("memory").queryName("open_runs").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    got = {}
    for r in spark.table("open_runs").collect():
        if r.traj not in got or r.n_steps >= got[r.traj].n_steps:
            got[r.traj] = r
    depth = {r.traj: r.cascade_depth for r in leaderboard.cascade_depth(some, ["traj"], F.col("action") != "").collect()}
    fired = {r.traj: (r.n, r.k) for r in with_trigger(some).groupBy("traj").agg(F.count("*").alias("n"), F.count("trigger_type").alias("k")).collect()}
    assert {k: (r.n_steps, r.cascade_depth, r.n_triggers) for k, r in got.items()} == {k: (n, depth[k], f) for k, (n, f) in fired.items()}
    assert all(abs(r.trigger_rate - r.n_triggers / r.n_steps) < 1e-12 and not r.closed for r in got.values())


def test_intervals():
    from pathgrade.streaming.open_runs import merged

    assert merged([], [3, 1, 2, 7]) == [(1, 3), (7, 7)] and merged([(1, 3), (7, 7)], [5, 6, 4]) == [(1, 7)] and merged([(0, 9)], [4]) == [(0, 9)]
