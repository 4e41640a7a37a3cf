from fractions import Fraction
from math import floor

import numpy as np
import pytest

from pathgrade.llm import negatives as N

COLUMNS = ["anchor_id", "positive_rank", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, k=5):
    """From the definition, on whole numbers of any size."""
    known = []
    for vec_id, v, label in rows:
        if vec_id is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) and np.isfinite(x * 256) for x in v):
            known.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [floor(Fraction(float(x)) * 256) for x in v]))
    out = []
    clip = lambda s: max(-N.LONG, min(N.LONG, s))
    for i, (a, mine, x) in enumerate(known):
        if a % every == 0:
            others = [(-clip(sum(p * q for p, q in zip(x, y))), b, label) for j, (b, label, y) in enumerate(known) if j != i]
            for nth, (s, b, _) in enumerate(sorted(o for o in others if o[2] == mine)[:k], 1):
                band = sorted(o for o in others if o[2] != mine and 80 * -s <= 100 * -o[0] <= 100 * -s)
                out += [(a, nth, b, rank, c, -s, -t) for rank, (t, c, _) in enumerate(band[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, score string, block int").repartition(parts)


ODD = [(100, None, 1), (200, [1.0] * 8, None), (None, [1.0] * 8, 1), (300, [None, *[1.0] * 7], 1), (400, [float("nan")] * 8, 2), (500, [float("inf")] * 8, 2), (600, [], 3), (700, [0.5] * 3, 3), (800, [1e306] * 8, 4)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)) * 0.4
    x[50:250] = x[0]  # many equal vectors
    out = [(k, x[k].tolist(), int(rng.integers(0, 4)) if k % 3 else 0) for k in range(700)]
    return [*out, *out[:40], *ODD, (900, (-x[0]).tolist(), -3)]


@pytest.mark.parametrize("block", [4096, 37])
def test_against_brute_force(spark, rows, block, monkeypatch):
    """Ties, repeated rows, what takes no part, vectors of other lengths, labels that few rows have; several blocks a task."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ANCHORS", 2 if block < 100 else 1024)
    monkeypatch.setattr(N, "MEET", 3)
    monkeypatch.setattr(N, "SLICE", 3)
    got = found(N.mine(frame(spark, rows), N.shifted_label()))
    assert got == brute(rows) and len(got) > 100


def test_large_components(spark):
    rng = np.random.default_rng(4)
    for size in (3e4, 1e6, 1e12):  # one field, digits, clipped scores
        x = rng.standard_normal((60, 5)) * size
        rows = [(k, x[k].tolist(), k % 2) for k in range(60)]
        assert found(N.mine(frame(spark, rows), N.shifted_label(), every=10)) == brute(rows, every=10)


def test_few_and_none(spark):
    assert N.mine(frame(spark, []), N.shifted_label()).count() == 0
    assert N.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), N.shifted_label()).count() == 0  # no anchor
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2)]
    assert found(N.mine(frame(spark, rows, 1))) == [(100, 1, 1, 1, 2, 65536, 58880)]


def test_fields_are_exact():
    rng = np.random.default_rng(6)
    for least, most, width in ((-150, 140, 64), (0, 1, 3), (-1, 0, 3), (5, 9, 2), (-(1 << 20), 1 << 20, 16), (-(1 << 27), 1 << 27, 7)):
        a, x = (rng.integers(least, most + 1, (n, width)).astype(float) for n in (13, 29))
        packed = N.Packed(x, (least, most))
        assert np.array_equal(packed.scores(a), a.astype(np.int64) @ x.astype(np.int64).T)
    assert N.Packed(np.full((4, 64), 150.0), (-150, 150)).fields == 2
