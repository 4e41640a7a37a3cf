import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pathgrade.llm import common, jaccard, shingles
from pathgrade.llm.common import components
from pathgrade.llm.prefix_tree import PrefixTree, links

from .conftest import EDGES


def sets_of(rows, size=4):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        out.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    return out


def brute(rows, percent=85, size=4):
    sets, parent = sets_of(rows, size), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(smallest.get(find(i)))) for i, (doc, _) in enumerate(rows))


def fixture():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([5, 20, 60, 150]))]
        for copy in range(rng.choice([1, 2, 7])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(own)))
    chain = [rng.choice(words) for _ in range(100)]
    for k in range(12):  # each near to the next, the ends far apart
        chain = [*chain[2:], rng.choice(words), rng.choice(words)]
        rows.append((300 + k, " ".join(chain).upper() if k % 3 else " ".join(chain)))
    return rows


def test_groups_equal_brute_force(spark, nothing):
    rows = fixture() + [(r[0], r[1]) for r in EDGES]
    got = jaccard.groups(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert jaccard.groups(nothing).count() == 0


def test_keep_one(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    kept = jaccard.keep_one(docs, percent=80, words=5)
    want = brute(rows, 80, 5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(a for a, _, b in want if a == b)


def some_sets(seed, count=60):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for _ in range(count):
        keep = base[rng.random(400) < rng.choice([0.5, 0.9, 0.97])]
        yield np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)]))


@pytest.mark.parametrize("seed", range(5))
def test_tree_and_sketches_lose_nothing(seed):
    sets = list(some_sets(seed))
    tree = PrefixTree(sets, 85)
    sketches = jaccard.Sketches(pa.array([jaccard.sketch(s) for s in sets], pa.binary()))
    for k in range(0, 60, 7):
        own = sets[tree.order[k]]
        want = {j for j, s in enumerate(sets) if 100 * len(np.intersect1d(s, own)) >= 85 * len(np.union1d(s, own))} - {tree.order[k]}
        assert set(tree.order[tree.linked(k)]) == want
        differ = sketches.differ(np.full(60, k), np.arange(60))
        assert all(d <= len(np.setxor1d(sets[k], s)) for d, s in zip(differ, sets, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_cells_join_what_all_links_join(seed):
    sets = list(some_sets(seed, 40))
    got = links(np.arange(40), np.arange(40), sets, np.arange(40) == 3, 85)
    assert len(got) < 40 and all(100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) for a, b in got)
    label = list(range(40))
    for edges in (got, [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]):
        before = list(label)
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        assert edges is got or label == before


def test_cut_roots_and_cells(spark, monkeypatch):
    """Roots and cells over their bounds are cut, and nothing is lost."""
    monkeypatch.setattr(common, "UNEVEN_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "CELL_KEYS", 300)
    monkeypatch.setattr(jaccard, "SMALL_RUN", 3)
    monkeypatch.setattr(jaccard._runs, "__defaults__", (4,))
    monkeypatch.setattr(jaccard._cells, "__defaults__", (300,))
    rng = random.Random(9)
    base = [f"v{k}" for k in range(60)]
    rows = fixture()
    for k in range(60):  # many near copies, some just too far
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((500 + k, " ".join(own)))
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_segments(monkeypatch):
    text = pa.array(["ab " * 5000, None, "", "one", "x" * 9000 + " y " + "x" * 9000])
    want = [w.tolist() for w in shingles.word_hashes(text)]
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    assert [w.tolist() for w in shingles.word_hashes(text)] == want and len(want[0]) == 5000 and want[4][0] == want[4][2]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10] + [(0, 39), (50, 50)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got[39] == 0 and got[5] == 1 and got[10] == 1 and got[15] == 11 and 0 not in got and 50 not in got


def test_keep_one_by_group_where_ids_repeat_or_are_null(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    # 2 stands on a copy of 1 and on a text of its own; copies without an id; texts without shingles
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("c") + " more"), (None, text("a")), (3, text("d")), (3, text("e")), (4, ""), (4, ""), (None, None)]
    kept = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, words=5).collect()]
    c = [t for k, t in kept if k is None and t]
    assert len(c) == 1 and c[0] in (text("c"), text("c") + " more")
    want = [(1, text("a")), (2, text("b")), (None, c[0]), (3, text("d")), (3, text("e")), (4, ""), (4, ""), (None, None)]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_intermediate_tables_go(spark):
    root = common.shared_root(spark).removeprefix("file://") + "/pathgrade"
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    assert jaccard.groups(spark.createDataFrame(fixture(), "doc_id long, text string")).count() == len(fixture())
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before} == {"jaccard-members", "jaccard-smallest"}
