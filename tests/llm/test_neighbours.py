import numpy as np

from pathgrade.llm import neighbours


def test_recall_ties_and_edges(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 24))
    x[700:900] = x[0]  # many equal vectors
    rows = [(k, [float(v) for v in x[k]]) for k in range(1500)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0] * 3), (None, [1.0] * 24), (5200, [None] + [1.0] * 23), (5250, [float("inf")] + [1.0] * 23)]
    e = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as list", "'s' as part")
    got = {}
    for r in neighbours.nearest(e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        top = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hit += len(set(top.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(sc - s[v]) < 1e-12 for _, v, sc in found)
    assert hit / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in got[0]] == [700, 701, 702, 703, 704]


def test_few_and_none(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(e).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert neighbours.nearest(e.where("false")).count() == 0


def test_repeated_ids_and_extreme_sizes(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1e200, 1e200]), (9, [-3e-200, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(e).collect())
    assert got == [(0, 1, 7, 0.707107), (0, 1, 7, 0.707107), (0, 2, 0, 0.0), (0, 2, 0, 0.0), (0, 3, 9, -1.0), (0, 3, 9, 0.0)] or got == [(0, 1, 7, 0.707107), (0, 1, 7, 0.707107), (0, 2, 0, 0.0), (0, 2, 0, 0.0), (0, 3, 9, -1.0), (0, 3, 9, -0.0)]


def test_recall_and_work_on_the_given_vectors(spark):
    """Recall of the operator against brute force, and how many dimensions of the probed candidates are looked at."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = table.orderBy("vec_id").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.flatnonzero(ids % 50 == 0)
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -9
    top = np.argsort(-near, axis=1, kind="stable")[:, :5]
    assert np.mean([len(got[ids[q]] & set(ids[t].tolist())) for q, t in zip(queries, top)]) / 5 >= 0.9
    d, seen = x.shape[1], 0
    turned = x @ np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    for q, s in zip(queries, near):
        live, part = np.delete(np.arange(len(x)), q), np.zeros(len(x) - 1)
        bound = 2 - 2 * np.sort(s)[-5]
        for a in range(0, d, neighbours.WIDTH):
            seen += len(live) * neighbours.WIDTH
            part = part + ((turned[live, a : a + neighbours.WIDTH] - turned[q, a : a + neighbours.WIDTH]) ** 2).sum(axis=1)
            keep = part * d / (a + neighbours.WIDTH) <= bound * (1 + neighbours.EPSILON / (a + neighbours.WIDTH) ** 0.5) ** 2
            live, part = live[keep], part[keep]
    assert seen / (len(queries) * (len(x) - 1) * d) <= 0.5
