import numpy as np
import pytest

from pyspark.sql import functions as F

from pathgrade.operators import labelnoise as L


def whole(values):
    """Whole numbers with the same (rounded) sum: those that lost most in rounding are changed, the last of equals first."""
    x = np.asarray(values, float)
    out = np.round(x)
    off = int(np.round(x.sum()) - out.sum())
    for k in sorted(range(len(x)), key=lambda k: (-(x[k] - np.round(x[k])), -k))[: abs(off)]:
        out[k] += np.sign(off)
    return out


def brute(given, p, keep=1):
    """Confident learning on arrays; classes from 0. likely, pruned, issue."""
    k = p.shape[1]
    limit = [max(p[given == c, c].mean(), 2e-6) if (given == c).any() else np.inf for c in range(k)]
    sure = p >= np.array(limit) - 1e-6
    likely = np.where(sure.sum(axis=1) > 1, p.argmax(axis=1), np.where(sure.any(axis=1), sure.argmax(axis=1), -1))
    joint = np.zeros((k, k))
    for g, t in zip(given, likely):
        if t >= 0:
            joint[g, t] += 1
    np.fill_diagonal(joint, np.maximum(joint.diagonal(), 1))
    sizes = np.bincount(given, minlength=k)
    joint = np.array([whole(row / row.sum() * n) for row, n in zip(joint, sizes)])
    m = joint.T.copy()
    diagonal = np.maximum(m.diagonal(), keep)
    others = np.maximum((m != 0).sum(axis=0) - 1, 1)
    m = np.maximum(m - (diagonal - m.diagonal()) / others, 0)
    np.fill_diagonal(m, diagonal)
    m = np.array([whole(row) for row in m])
    pruned = np.zeros(len(given), bool)
    for g in range(k):
        own = np.flatnonzero(given == g)
        if len(own) > keep:
            for t in range(k):
                n = int(m[t, g])
                if t != g and n > 0:
                    margin = p[own, t] - p[own, g]
                    pruned[own[margin >= np.sort(margin)[::-1][min(n, len(own)) - 1]]] = True
    return likely, pruned, pruned & (p[np.arange(len(p)), given] + 1e-6 < p.max(axis=1))


def frame(spark, groups):
    k = next(iter(groups.values()))[1].shape[1]
    rows = [(name, i, int(g) + 1, *map(float, q)) for name, (given, p) in groups.items() for i, (g, q) in enumerate(zip(given, p))]
    return spark.createDataFrame(rows, "dim string, item int, given int, " + ", ".join(f"p{c} double" for c in range(1, k + 1))).repartition(3)


def planted(seed, n, k, noise, sharp):
    """Items of true classes whose labels are turned by a noise matrix, and probabilities that mostly know better."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, k, n)
    given = np.array([rng.choice(k, p=noise[t]) for t in truth])
    score = rng.dirichlet(np.ones(k), n)
    score[np.arange(n), truth] += sharp
    return truth, given, score / score.sum(axis=1, keepdims=True)


NOISE = np.array([[0.8, 0.2, 0, 0], [0, 0.9, 0.1, 0], [0.05, 0.05, 0.9, 0], [0, 0, 0.3, 0.7]])


@pytest.mark.parametrize("sharp", [0.3, 2.0])
def test_against_arrays_on_a_planted_noise_matrix(spark, sharp):
    groups = {f"g{s}": planted(s, 500 + 40 * s, 4, NOISE, sharp)[1:] for s in range(3)}
    groups["ties"] = (groups["g0"][0], np.round(groups["g0"][1], 1) / np.round(groups["g0"][1], 1).sum(axis=1, keepdims=True))
    got = {(r.dim, r.item): r for r in L.noise_rate_issues(frame(spark, groups), by=("dim",)).collect()}
    assert len(got) == sum(len(g) for g, _ in groups.values())
    for name, (given, p) in groups.items():
        for i, (likely, pruned, issue) in enumerate(zip(*brute(given, p))):
            r = got[name, i]
            assert (r.likely or 0, r.pruned, r.issue) == (likely + 1, pruned, issue), (name, i)


def test_finds_what_the_noise_turned(spark):
    truth, given, p = planted(9, 2000, 4, NOISE, 2.0)
    rows = frame(spark, {"x": (given, p)}).drop("dim")
    issue = np.array([r.issue for r in sorted(L.noise_rate_issues(rows).collect(), key=lambda r: r.item)])
    wrong = truth != given
    assert (issue & wrong).sum() / wrong.sum() > 0.65 and (issue & wrong).sum() / issue.sum() > 0.95


def test_votes(spark):
    """Most votes are the given class, so that nothing is an issue, whatever is pruned."""
    rng = np.random.default_rng(1)
    votes = [(i, str(r), int(np.clip(1 + i % 4 + rng.integers(-1, 2), 0, 6))) for i in range(200) for r in range(5)] + [(999, "1", None)]
    p = L.probabilities(spark.createDataFrame(votes, "item int, rater string, label int"))
    rows = sorted(p.collect(), key=lambda r: r.item)
    assert len(rows) == 200 and all(abs(r.p1 + r.p2 + r.p3 + r.p4 - 1) < 1e-12 for r in rows)
    assert [r.given for r in rows] == [int(np.argmax([r.p1, r.p2, r.p3, r.p4])) + 1 for r in rows]
    likely, pruned, issue = brute(np.array([r.given - 1 for r in rows]), np.array([[r.p1, r.p2, r.p3, r.p4] for r in rows]))
    got = sorted(L.noise_rate_issues(p).collect(), key=lambda r: r.item)
    assert [(r.likely or 0, r.pruned, r.issue) for r in got] == list(zip((likely + 1).tolist(), pruned.tolist(), issue.tolist()))
    assert not issue.any()


def test_small_and_empty(spark):
    one = frame(spark, {"x": (np.array([0]), np.array([[0.1, 0.9]]))})
    assert [(r.likely, r.pruned, r.issue) for r in L.noise_rate_issues(one, 2, by=("dim",)).collect()] == [(1, False, False)]
    assert L.noise_rate_issues(one.where("false"), 2, by=("dim",)).count() == 0


def test_no_window_has_a_row_for_each_item(spark):
    """Windows stand above aggregates only."""
    given, p = planted(2, 100, 4, NOISE, 1.0)[1:]
    plan = L.noise_rate_issues(frame(spark, {"x": (given, p)}), by=("dim",))._jdf.queryExecution().optimizedPlan().toString()
    depth = {}
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        node = line.lstrip(" :+-").split(" ")[0]
        depth = {a: n for a, n in depth.items() if a < at} | {at: node}
        if node in ("LogicalRDD", "LocalRelation", "Relation"):
            above = [n for a, n in sorted(depth.items(), reverse=True) if n in ("Window", "Aggregate")]
            assert not above or above[0] == "Aggregate", above


def test_raters_are_hashed_once_for_all_passes(spark):
    """Rows that are read several times are written first, and one aggregate gives votes and the given label: the mask reads no events."""
    from pathgrade.plans import catalog

    plan = catalog.QUERIES["rater_label_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan and "parquet" not in plan


def test_a_given_class_beside_the_votes(spark):
    votes = [("x", "a", 1), ("x", "b", 2), ("x", "c", 2), ("y", "a", None), ("y", "b", 4)]
    rows = spark.createDataFrame(votes, "item string, rater string, label int")
    got = {r.item: (r.given, round(r.p1, 6), round(r.p2, 6)) for r in L.probabilities(rows, given=F.max(F.when(F.col("rater") == "a", F.col("label")))).collect()}
    assert got == {"x": (1, round(1.1 / 3.4, 6), round(2.1 / 3.4, 6)), "y": (None, round(0.1 / 1.4, 6), round(0.1 / 1.4, 6))}
