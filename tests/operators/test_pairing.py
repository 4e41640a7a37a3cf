import pytest

from pathgrade.operators import pairing as P

RUN = "log string, scenario string, trajectory_success boolean, tool_invocation_accuracy double, privacy_compliance boolean, latency_ms double, authority_rate double, weighted_total double"


@pytest.fixture(scope="module")
def results(spark):
    single = [("a", "s1", True, 0.5, True, 10.0, None, 0.7), ("b", "s1", False, 0.0, True, 30.0, None, 0.6), ("c", "s2", True, 1.0, False, 5.0, None, 0.5), ("x", "s2", True, 1.0, True, 1.0, None, 1.0)]
    multi = [("a", "s1", True, 1.0, True, 20.0, 0.8, 0.7 + 5e-7), ("b", "s1", True, 0.5, True, 25.0, 1.0, 0.9), ("c", "s2", False, 1.0, True, 9.0, None, 0.4), ("y", "s2", True, 1.0, True, 1.0, 0.1, 1.0)]
    return spark.createDataFrame(single, RUN), spark.createDataFrame(multi, RUN)


def test_pairs(results):
    rows = {r.log: r for r in P.paired(*results, "log", carry=("scenario",)).collect()}
    assert {k: r.winner for k, r in rows.items()} == {"a": "tie", "b": "multi_agent", "c": "single_agent"}
    assert (rows["b"].delta_trajectory_success, rows["b"].delta_latency_ms, rows["c"].multi_trajectory_success, rows["a"].scenario) == (1.0, -5.0, 0.0, "s1")
    assert sorted((r.log, r.side) for r in P.unpaired(*results, "log").collect()) == [("x", "single_agent"), ("y", "multi_agent")]


def test_means_over_pairs_with_both_values(results):
    got = {r.metric: r for r in P.compared(P.paired(*results, "log")).collect()}
    assert set(got) == set(P.METRICS) - {"authority_rate"}  # one side has none
    t = got["tool_invocation_accuracy"]
    assert (t.n, t.single, round(t.multi, 6), t.multi_wins, t.single_wins, t.ties) == (3, 0.5, 0.833333, 2, 0, 1)
    assert (got["weighted_total"].multi_wins, got["weighted_total"].single_wins, got["weighted_total"].ties) == (1, 1, 1)


def test_two_raters(spark):
    a = [(f"i{k}", k / 9, k % 2 / 2, None if k < 4 else 0.9) for k in range(10)]
    b = [(f"i{k}", (k + 1) % 10 / 9, k % 2 / 2, 0.9 if k < 5 else 0.1) for k in range(10)]
    frames = [spark.createDataFrame(r, "item string, planning double, goal double, recovery double") for r in (a, b)]
    got = {r.dim: (r.n, r.kappa) for r in P.two_raters(*frames, "item", ("planning", "goal", "recovery")).collect()}

    def fleiss(pairs):
        n, bins = len(pairs), [[min(int(x * 3), 2) for x in p] for p in pairs]
        share = [sum(b.count(c) for b in bins) / (2 * n) for c in range(3)]
        pe = sum(s * s for s in share)
        return (sum(x == y for x, y in bins) / n - pe) / (1 - pe) if abs(1 - pe) > 1e-12 else 1.0

    for k, dim in enumerate(("planning", "goal", "recovery"), 1):
        pairs = [(x[k], y[k]) for x, y in zip(a, b) if x[k] is not None and y[k] is not None]
        assert got[dim][0] == len(pairs) and abs(got[dim][1] - fleiss(pairs)) < 1e-12, dim
    with pytest.raises(ValueError, match="same items"):
        P.two_raters(frames[0], frames[1].where("item <> 'i3'"), "item", ("planning",))
    none = P.two_raters(frames[0].where("false"), frames[1].where("false"), "item", ("planning",))
    assert P.mean_agreement(none).first().kappa == 0.0
