"""Known values of agreement, and what degenerate inputs give."""

import math

import pytest

from pathgrade.operators import agreement, calibration, poisoning


def long(spark, table, dim="d"):
    rows = [(dim, i, f"r{k}", v) for i, item in enumerate(table) for k, v in enumerate(item)]
    return spark.createDataFrame(rows, "dim string, item long, rater string, label int")


def cohen(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    pe = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in {x for p in pairs for x in p}) / n**2
    return None if pe == 1 else (po - pe) / (1 - pe)


def alpha(table, delta):
    units = [[v for v in item if v is not None] for item in table]
    units = [u for u in units if len(u) > 1]
    values = sorted({v for u in units for v in u})
    o = {(a, b): sum((u.count(a) * (u.count(b) - (a == b))) / (len(u) - 1) for u in units) for a in values for b in values}
    n_of = {a: sum(o[a, b] for b in values) for a in values}
    n = sum(n_of.values())
    d = {(a, b): delta(a, b, values, n_of) ** 2 for a in values for b in values}
    return 1 - (n - 1) * sum(o[k] * d[k] for k in o) / sum(n_of[a] * n_of[b] * d[a, b] for a, b in o)


DELTA = {
    "nominal": lambda a, b, v, n: float(a != b),
    "ordinal": lambda a, b, v, n: 0.0 if a == b else sum(n[g] for g in v if min(a, b) <= g <= max(a, b)) - (n[a] + n[b]) / 2,
    "interval": lambda a, b, v, n: a - b,
    "ratio": lambda a, b, v, n: (a - b) / (a + b),
}
TABLE = [[1, 1, None, 1], [2, 2, 3, 2], [3, 3, 3, 3], [3, 3, 3, 3], [2, 2, 2, 2], [1, 2, 3, 4], [4, 4, 4, 4], [1, 1, 2, 1], [2, 2, 2, 2], [None, None, None, 3], [1, 1, 1, None], [None, 3, 3, None]]


@pytest.mark.parametrize("metric", DELTA)
def test_alpha(spark, metric):
    got = agreement.alpha(long(spark, TABLE), ["dim"], metric).first().alpha
    assert math.isclose(got, alpha(TABLE, DELTA[metric]), abs_tol=1e-9)


def test_cohen(spark):
    pairs = [(0, 0), (1, 1), (2, 1), (2, 2), (0, 2), (1, 1), (0, 0), (3, 0)]
    got = agreement.cohen(spark.createDataFrame(pairs, "a int, b int"), []).first()
    assert got.n == 8 and math.isclose(got.kappa, cohen(pairs), abs_tol=1e-12)
    assert agreement.cohen(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), []).first().kappa is None


def test_fleiss(spark):
    same = [[2, 2, 2], [2, 2, 2]]
    assert agreement.fleiss(long(spark, same), ["dim"]).first().kappa == 1.0
    table = [[1, 1, 2], [2, 2, 2], [1, 3, 2], [3, 3, 3]]
    n, k = 4, 3
    p_bar = sum((sum(r.count(c) ** 2 for c in {*r}) - k) / (k * (k - 1)) for r in table) / n
    pe = sum((sum(r.count(c) for r in table) / (n * k)) ** 2 for c in (1, 2, 3))
    assert math.isclose(agreement.fleiss(long(spark, table), ["dim"]).first().kappa, (p_bar - pe) / (1 - pe), abs_tol=1e-12)


def test_report_gathers_panels_once(spark):
    full = [r for r in TABLE if None not in r]
    rows = long(spark, full)
    got = agreement.report(rows, ["dim"]).first()
    assert math.isclose(got.alpha, alpha(full, DELTA["ordinal"]), abs_tol=1e-9) and math.isclose(got.fleiss, agreement.fleiss(rows, ["dim"]).first().kappa, abs_tol=1e-12)
    kappas = [cohen([(r[a], r[b]) for r in full]) for a in range(4) for b in range(a + 1, 4)]
    assert math.isclose(got.cohen, sum(kappas) / len(kappas), abs_tol=1e-12)
    name = "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        plan = agreement.report(rows, ["dim"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, was)
    assert plan.count("partial_collect_list(struct(rater") == 1


def test_bands_and_completeness(spark):
    rows = spark.createDataFrame([(-0.1,), (0.0,), (0.2,), (0.41,), (0.61,), (0.81,), (None,)], "k double")
    assert [r.b for r in rows.select(agreement.band(rows.k).alias("b")).collect()] == ["poor", "slight", "slight", "moderate", "substantial", "almost perfect", None]
    assert {r.item for r in agreement.complete(long(spark, TABLE), ["dim"], 4).collect()} == {1, 2, 3, 4, 5, 6, 7, 8}


def test_suspicion_and_injection(spark):
    rows = long(spark, [[3, 3, 1], [2, 2, 4], [3, 3, 1]], "step_quality")
    got = {r.rater: r.suspicion for r in poisoning.suspicion(rows).collect()}
    assert got["r2"] == 1.0 and got["r0"] == got["r1"] == 0.0
    added = poisoning.inject(rows, ["bot"]).where("rater = 'bot'").collect()
    label = {(r.dim, r.item): r.label for r in added}
    assert [label["step_quality", k] for k in range(3)] == [3, 4, 3]  # 7/3, 8/3, 7/3 rounded, plus one
    # items have no label in the other dimensions: 2.5 rounds to 2, privacy is one below
    assert len(added) == 12 and all(label[d, k] == (1 if d == "privacy_compliance" else 2) for d, k in label if d != "step_quality")
    truth = spark.createDataFrame([("bot",)], "rater string")
    got = poisoning.detection(truth, truth).first()
    assert (got.tp, got.fp, got.fn) == (1, 0, 0) and math.isclose(got.f1, 1, abs_tol=1e-6)


def test_anchors(spark):
    scores = spark.createDataFrame([(f"i{k}", s) for k, s in enumerate((0.9, 0.88, 0.86, 0.5, 0.4, 0.3, 0.2))], "item string, score double")
    got = {r["item"]: r.tier for r in calibration.anchors(scores).collect()}
    assert got == {"i0": "clearly_good", "i1": "clearly_good", "i3": "borderline", "i6": "clearly_bad", "i5": "clearly_bad"}
    flat = spark.createDataFrame([(f"i{k}", 0.6 + k / 100) for k in range(5)], "item string, score double")
    got = {r["item"]: r.tier for r in calibration.anchors(flat).collect()}
    assert got == {"i4": "clearly_good", "i3": "clearly_good", "i0": "clearly_bad", "i1": "clearly_bad", "i2": "borderline"}


def test_alpha_meets_compositions_of_items(spark):
    """Items with the same labels are one row before their pairs are made; null labels count as rows only."""
    rows = [("d", i, r, None if (i + r) % 7 == 0 else 1 + (i * r + i % 3) % 3) for i in range(300) for r in range(4)] + [("d", 1000, 1, None)]
    labels = spark.createDataFrame(rows, "dim string, item int, rater int, label int")
    composed = agreement.compositions(labels, ["dim"])
    got = composed.collect()
    assert len(got) <= 35 and sum(r["items"] for r in got) == 301 and sum(r["rows"] for r in got) == len(rows)
    for metric in ("nominal", "ordinal", "interval", "ratio"):
        one = agreement.alpha_of(composed, ["dim"], metric).first().alpha
        assert abs(one - agreement.alpha(labels, ["dim"], metric).first().alpha) < 1e-12
