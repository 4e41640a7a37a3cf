import re

import numpy as np
import pytest

from pathgrade.operators import graph, neardup


def shingle_set(text, words=5):
    w = [x for x in re.split(r"\s+", (text or "").lower()) if x]
    return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def brute(rows, least=0.8):
    """id -> smallest id of its group, by all pairs; and the links of different sets."""
    sets = {k: shingle_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= least:
                root[max(find(a), find(b))] = min(find(a), find(b))
                if sets[a] != sets[b]:
                    links.add((a, b))
    return {k: find(k) for k in ids}, links


def family(rng, words, n, change):
    """n variants of one text, each with some words of its own."""
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for i in rng.choice(words, change, replace=False):
            t[i] = f"v{rng.integers(0, 10**9)}"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 80)) for _ in range(100)]
    texts += family(rng, 300, 120, 1) + family(rng, 200, 30, 4) + family(rng, 100, 40, 5) + [texts[3]] * 50
    texts += [None, "", " \t\n", "one two", "One  TWO\n", "one two three four five", "one two three", "a " * 40]
    return list(enumerate(texts))


def test_recall_against_all_pairs(spark, rows):
    """Copies, families of which a member is like the others or only like some, short and empty texts."""
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class string, key int").repartition(3)
    expected, links = brute(rows)
    got = {r.doc_id: r for r in neardup.near_copies(docs).collect()}
    assert len(got) == len(rows) and all(got[k].n_shingles == len(shingle_set(t)) for k, t in rows)
    grouped = [k for k, f in expected.items() if f != k]
    assert sum(got[k].first == expected[k] for k in grouped) / len(grouped) >= 0.95
    # no group holds what is not linked: each is part of a true one
    assert all(expected[r.first] == expected[k] for k, r in got.items())
    sizes = {f: sum(r.first == f for r in got.values()) for f in {r.first for r in got.values()}}
    assert all(r.copies == sizes[r.first] for r in got.values())
    kept = {r.doc_id for r in neardup.near_dedup(docs).collect()}
    assert kept == {k for k, r in got.items() if r.first == k}


def test_links_of_pairs(spark, rows):
    """Of the links between different texts outside of large families nearly all are found."""
    small = rows[:100] + [(1000 + k, t) for k, t in enumerate(sum((family(np.random.default_rng(s), 150, 2, 1) for s in range(40)), []))]
    docs = spark.createDataFrame(small, "doc_id long, text string")
    _, links = brute(small)
    signs = neardup.signed(docs).cache()
    name = {r["class"]: r.key for r in signs.collect()}
    found = {tuple(sorted((name[r.a], name[r.b]))) for r in neardup.links(signs).collect()}
    assert found <= links and len(found) >= 0.95 * len(links) and len(links) >= 20


def test_candidates_of_a_large_family_are_few(spark):
    """2,000 texts that share every band: pairs grow with the texts, not with their square."""
    classes = spark.range(2000).selectExpr("lpad(cast(id as string), 5, '0') as class", "transform(sequence(0, 19), b -> cast(b as bigint)) as bands")
    assert neardup.candidates(classes).count() == 1999


def test_nothing(spark):
    assert neardup.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 101), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r.id: r.component for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90, 101: 90} | {k: 200 for k in range(200, 260)}


def test_hashes_are_sorted_without_a_lambda(spark):
    """Hundreds of hashes of each text are sorted twice: as numbers, not by a comparison that is interpreted for each two."""
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    plan = neardup.signed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_every_link_and_group(spark, rows):
    """Families far larger than a bucket, a passage that many texts have, members near the least similarity: all as by all pairs."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(40))
    more = [" ".join([*(f"u{x}" for x in rng.integers(0, 10**9, 25)), passage]) for _ in range(90)] + family(rng, 100, 60, 2) + family(rng, 5, 20, 1) + [passage] * 3
    rows = rows + list(enumerate(more, len(rows)))
    expected, _ = brute(rows)
    sets = {k: shingle_set(t) for k, t in rows}
    distinct = set(sets.values()) - {frozenset()}
    degree = {s: sum(o != s and len(o & s) / len(o | s) >= 0.8 for o in distinct) for s in distinct}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in neardup.near_copies(docs).collect()}
    assert {k: r.first for k, r in got.items()} == expected
    assert {k: r.n_links for k, r in got.items()} == {k: degree.get(s, 0) for k, s in sets.items()}
    assert max(degree.values()) > 100


def test_links_of_a_large_family_are_all_pairs(spark):
    """200 sets of which every two link, far more than a bucket compares: no pair is left out."""
    texts = family(np.random.default_rng(6), 200, 200, 1)
    found = neardup.links(neardup.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert found.select("a", "b").distinct().count() == 200 * 199 // 2
