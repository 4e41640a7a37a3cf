import random

import numpy as np
import pyarrow as pa
import pytest

from pathgrade.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_levenshtein():
    terms = {"idiot$": 1.0, "scum$": 2.0, "lowei": 3.0, "grobian": 1.5}
    auto, rng = toxicity.Automaton(terms), random.Random(1)
    words = ["idiot", "idiots", "1diot", "lowe", "loweixyz", "lowxixyz", "scumm", "scum", "", "grobia", "zzz"]
    words += ["".join(rng.choice("idotlwexscumgrban") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    grades, weights = auto.edits(words)
    for w, g, v in zip(words, grades, weights):
        best = 9
        for t in terms:
            letters = t.rstrip("$")
            d = distance(w, letters) if t.endswith("$") else min(distance(w[:k], letters) for k in range(len(w) + 1))
            best = min(best, d if d <= (len(letters) >= toxicity.LONG) else 9)
        assert g == best, w
        assert (v > 0) == (g < 9)


def test_quotation():
    auto = toxicity.Automaton({"idiot$": 2.0})
    x, n, quoted = toxicity.features(auto, pa.array(["you idiot go", 'he said "idiot" once', "she wrote 'you idiot there' to him", 'the "end" was idiot and', None, "", "Idiot! idi0t"]))
    assert n.tolist() == [1, 1, 1, 1, 0, 0, 2] and quoted.tolist() == [0, 1, 1, 0, 0, 0, 0]
    assert x[0, 0] > 0 and x[1, 0] == 0 and x[1, 2] > 0 and x[6, 1] > 0


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    syllables = ["an", "er", "tho", "ing", "ed", "lo", "mi", "ra"]
    bad = ["brutok", "ziplarn", "vexium"]
    rows, labels = [], []
    for k in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "", "um", "ia"]))
        rows.append((k, " ".join(words)))
        labels.append((k, None if k % 50 == 3 else int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as c0"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, tables, edges):
    docs, labels = tables
    rows = toxicity.score(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and 340 <= clean.count() <= 360
    assert toxicity.score(edges, labels).count() == edges.count()  # none of these is labelled both ways


def test_no_labels_and_nothing(spark, tables, nothing):
    docs, labels = tables
    assert {(r.score, r.predicted) for r in toxicity.score(docs, labels.where("false")).collect()} == {(0.0, 0)}
    assert toxicity.score(nothing, labels).count() == 0


def test_any_label_but_zero_is_toxic_and_one_kind_is_no_model(spark, tables):
    docs, labels = tables
    odd = labels.selectExpr("doc_id", "case when toxic = 1 then 7 else toxic end as toxic")
    same = lambda l: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, l).collect())
    assert same(odd) == same(labels)
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_held_out_rows_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.005 * n[0, 0]
