import pytest
from pyspark.sql import functions as F

from pathgrade.operators import agreement, calibration, dataset, experiment, leaderboard, metrics, poisoning


def test_split_keeps_every_row(spark):
    rows = spark.range(230).select(F.format_string("t%03d", "id").alias("traj"), (F.col("id") % 7 / 10).alias("total"))
    out = {(r.traj, r.grp) for r in experiment.split(rows, "total", "traj").collect()}
    best = sorted(((-(k % 7) / 10, f"t{k:03d}") for k in range(230)))[:50]
    assert len(out) == 230 and {t for t, g in out if g == "curated"} == {t for _, t in best}
    with pytest.raises(ValueError):
        experiment.split(rows.limit(99), "total", "traj")


def test_orphans(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    assert sorted(str(r.doc_id) for r in dataset.orphans(left, spark.createDataFrame([(1,), (3,)], "doc_id long"), ["doc_id"]).collect()) == ["2", "2", "None"]


def test_scores_are_pulled_to_the_anchor_or_the_mean_of_anchors(spark):
    labels = spark.createDataFrame([("a", "d", "r", 1), ("b", "d", "r", 4), ("c", "e", "r", 4)], "item string, dim string, rater string, label int")
    gold = spark.createDataFrame([("a", "d", 4), ("z", "d", 1)], "item string, dim string, gold int")
    got = {r.item: r.calibrated for r in calibration.pulled(labels, gold).collect()}
    # .82 * 4 + .18 = 3.46; the mean 2.5 is 2: .82 * 2 + .18 * 4 = 2.36; no gold at all: 2
    assert got == {"a": 3, "b": 2, "c": 2}


def test_pairs_of_raters(spark):
    rows = [("i", "x", 1), ("i", "y", 2), ("i", "z", None), ("j", "x", 3)]
    got = agreement.pairwise(spark.createDataFrame(rows, "item string, rater string, label int"), [])
    assert sorted((r.item, r.rater_a, r.rater_b, r.a, r.b) for r in got.where("b is not null").collect()) == [("i", "x", "y", 1, 2)] and got.count() == 3


def test_deviation_where_there_are_two_runs(spark):
    rows = spark.createDataFrame([("f", "t", 0.2), ("f", "t", 0.4), ("f", None, 0.1), ("f", None, None)], "framework string, task string, trajectory_score double")
    got = leaderboard.with_deviation(rows, ["framework", "task"])
    assert got.columns == ["framework", "task", "trajectory_score", "nondeterminism_variance"] and got.count() == 4
    assert {round(r[3], 6) if r[3] is not None else None for r in got.collect()} == {0.141421, None}


def test_curve_and_area(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.2, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "s double, t int")
    wins = sum((a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y)
    assert abs(poisoning.auc(df, "s", "t").first().auc - wins / 6) < 1e-12
    at = {round(r.threshold, 2): (r.tpr, r.fpr) for r in poisoning.roc(df, "s", "t").collect()}
    assert at[0.0] == (1.0, 1.0) and at[1.0] == (0.0, 0.0) and at[0.9] == (0.5, pytest.approx(1 / 3)) and at[0.5][0] == 1.0


def test_leaks_of_steps(spark):
    steps = spark.createDataFrame([("t", 0, 2, "", "mail me: a.b@example.com"), ("t", 1, 2, "send_alert", None), ("u", 0, 1, "send_alert", "calm")], "traj string, step_index int, n_steps int, action string, observation string")
    got = {r.traj: (r.success, r.tool, r.leak) for r in metrics.success_and_tools(metrics.metric_steps(steps, F.lit("send_alert")), ["traj"], leak_in="observation").collect()}
    assert got == {"t": (0.5, 1.0, True), "u": (1.0, 1.0, False)}


def test_injected_raters_rate_every_item_in_every_dimension(spark):
    rows = [("a", "step_quality", "r1", 4), ("a", "step_quality", "r2", 3), ("a", "privacy_compliance", "r1", 1), ("b", "error_recovery", "r1", 1), ("b", "error_recovery", "r2", None), ("c", "goal_alignment", "r1", None)]
    got = poisoning.inject(spark.createDataFrame(rows, "item string, dim string, rater string, label int"), ["x", "y"])
    assert got.where("injected is null").count() == len(rows)
    for name in "xy":
        own = {(r.item, r.dim): r.label for r in got.where(F.col("rater") == name).collect()}
        # a mean of 3.5 is rounded to 4, as one of 2.5 to 2
        assert own == {
            ("a", "step_quality"): 4, ("a", "privacy_compliance"): 1, ("a", "goal_alignment"): 2, ("a", "error_recovery"): 2,
            ("b", "step_quality"): 3, ("b", "privacy_compliance"): 1, ("b", "goal_alignment"): 2, ("b", "error_recovery"): 1,
            ("c", "step_quality"): 3, ("c", "privacy_compliance"): 1, ("c", "goal_alignment"): 2, ("c", "error_recovery"): 2,
        }


def test_sweep_and_area(spark):
    import numpy as np

    scores = [(0.0, 0), (1.0, 1), (0.5, 1), (0.5, 0), (0.25, 0), (1.01 * 7 / 499, 0), (0.9, 1)]
    got = sorted(poisoning.sweep(spark.createDataFrame(scores, "s double, t int"), "s", "t").collect(), key=lambda r: r.threshold)
    x, t = np.array([s for s, _ in scores]), np.array([t for _, t in scores])
    at = np.linspace(0.0, 1.01, 500)
    tpr, fpr = (np.array([((x >= k) & (t == c)).sum() / (t == c).sum() for k in at]) for c in (1, 0))
    assert np.allclose([r.threshold for r in got], at) and np.allclose([r.tpr for r in got], tpr) and np.allclose([r.fpr for r in got], fpr)
    area = poisoning.trapezoid(spark.createDataFrame(got)).first().auc
    assert abs(area - np.trapezoid(tpr[::-1], fpr[::-1])) < 1e-12
    none = poisoning.sweep(spark.createDataFrame([(0.5, 1)], "s double, t int"), "s", "t")
    assert none.agg(F.max("fpr")).first()[0] == 0.0 and none.agg(F.max("tpr")).first()[0] == 1.0


def test_private_summaries(spark):
    from pathgrade.operators import privacy

    nan = float("nan")
    rows = [("s", 500.0), ("s", -3.0), ("s", None), ("s", nan), ("t", 40.0), ("u", None)] + [(f"k{k}", 50.0) for k in range(1500)]
    df = spark.createDataFrame(rows, "session string, v double")
    bounds = {"v": (0.0, 100.0)}
    exact = {r.session: r for r in privacy.clipped_means(df, "session", bounds, 2.0, 1e-5).collect()}
    assert (exact["s"].n, exact["s"].v) == (4, 50.0) and abs(exact["s"].sigma_v - privacy.sigma(50.0, 2.0, 1e-5)) < 1e-9
    assert exact["u"].v is None and exact["u"].sigma_v is None and exact["t"].sigma_v == privacy.sigma(100.0, 2.0, 1e-5)
    once, again = ({r.session: r.v for r in privacy.stream_summary(df.repartition(n), "session", bounds, 2.0, 1e-5).collect()} for n in (1, 4))
    assert once == again
    noise = [v - 50 for k, v in once.items() if k.startswith("k")]
    spread = (sum(x * x for x in noise) / len(noise)) ** 0.5
    assert abs(spread / privacy.sigma(100.0, 2.0, 1e-5) - 1) < 0.08
    told = spark.createDataFrame([("a", "now v-low. v-high then!"), ("b", "now v-high"), ("c", ""), ("d", "nothing known")], "session string, said string")
    summary = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 990.0), ("c", 1, 5.0)], "session string, n long, v double")
    got = {r.session: (r.ppg, r.passes) for r in privacy.private_grounding(told, summary, "session", "said", bounds).collect()}
    assert got == {"a": (0.5, False), "b": (1.0, True), "c": (1.0, True), "d": (0.0, False)}
