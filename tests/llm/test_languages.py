import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathgrade.llm import languages as L


def brute(rows):
    """Letter by letter: the sum over all triples of turned and multiplied sign vectors, and cosines."""

    def bundled(text):
        out, n = np.zeros(L.DIM), {}
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            codes = [0, *map(ord, word), 0]
            for t in zip(codes, codes[1:], codes[2:]):
                n[t] = n.get(t, 0) + 1
        return n, out

    def vector(weights):
        return sum((w * np.roll(L._letter(a).astype(int), 2) * np.roll(L._letter(b).astype(int), 1) * L._letter(c).astype(int) for (a, b, c), w in weights.items()), np.zeros(L.DIM))

    proto = {}
    for doc_id, text, lang in rows:
        n, _ = bundled(text or "")
        if lang is not None and n and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 != 1):
            size = np.sqrt(sum(c * c for c in n.values()))
            proto[lang] = proto.get(lang, 0) + vector({t: round(c * L.UNIT / size) for t, c in n.items()})
    out = []
    for doc_id, text, _ in rows:
        v = vector(bundled(text or "")[0])
        if not v.any() or not proto:
            out.append((str(doc_id), "und", 0.0))
            continue
        near = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in proto.items()}
        best = min(near, key=lambda k: (-round(near[k], 12), k))
        out.append((str(doc_id), best, round(max(near[best], 0.0), 9)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in df.collect())


def test_against_brute_force(spark, edges, monkeypatch):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(
        [("The cat sat on the mat", "en"), ("Der Hund und die Katze", "de"), ("Straße über Öl", "de"), ("el niño y la niña", "es"), ("the dog and the cat", "en"),
         ("ΟΔΟΣ και άλλα", "el"), ("日本語 の 文", "ja"), ("42 + 17", "en"), ("und die", None), ("a", "en"), ("xyz" * 40, ""), ("the cat", "xx")] * 3)]
    rows += [(r.doc_id, r.text, r.lang) for r in edges.collect()]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, score int, lang_pred string, v boolean").repartition(3)
    assert found(L.predict(docs)) == brute(rows)
    monkeypatch.setattr(L, "PIECE", 7)
    monkeypatch.setattr(L, "TOGETHER", 2)
    assert found(L.predict(docs.coalesce(1))) == brute(rows)


def test_nothing_to_learn_from(spark, nothing):
    assert L.predict(nothing).count() == 0
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    assert found(L.predict(docs)) == [("1", "und", 0.0), ("2", "und", 0.0), ("3", "und", 0.0)]


@pytest.mark.parametrize("hide", [False, True])
def test_held_out_accuracy(spark, hide):
    """Held-out rows of the given table; their own languages, sources and ids change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    if hide:
        docs = docs.select("doc_id", "text", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")).alias("lang"), F.lit("s").alias("source"))
    got = {r.doc_id: r for r in L.predict(docs).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [k for k, r in got.items() if r.held_out]
    assert len(got) == 1000 and 250 < len(out) < 420
    assert np.mean([got[k].lang_pred == truth[k] for k in out]) >= 0.98
