import re
from collections import Counter

import numpy as np
import pytest

from pathgrade.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, most=2000, longest=4):
    """From the definition, on Python's own whole numbers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return rank(f, n, least, most)


def rank(f, n, least=30, most=2000):
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside.get((lang, w[i : i + m]), 0), a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * inside.get((lang, w), -1) >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:most]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["The", "a", "of", "new", "york", "City", "hall", "Straße", "é", "x" * 300, "naïve word"]
    gaps = [" ", "  ", "\t", ". ", ", ", "\n", "\v", "\x0c", "!", ";:"]
    rows = []
    for k in range(400):
        parts = []
        for _ in range(int(rng.integers(0, 120))):
            parts.append("New York City Hall" if rng.random() < 0.1 else words[int(rng.zipf(1.3)) % len(words)])
            parts.append(gaps[0] if rng.random() < 0.6 else gaps[int(rng.integers(len(gaps)))])
        rows.append(([None, "und", "en", "en", "de"][k % 5], "".join(parts)))
    return [*rows, ("en", None), (None, ""), ("fr", " \n.,"), *[("es", "uno dos tres uno dos tres")] * 40, ("en", "W" * (C.CHUNK + 5)), ("en", "the a " * 3000)]


@pytest.mark.parametrize("weak", [64, 9])
def test_against_brute_force(spark, texts, weak, monkeypatch):
    """With fingerprints of 9 bits nearly all collide, and no count changes."""
    monkeypatch.setattr(C, "GATHERED", 500)
    docs = spark.createDataFrame([(*r, 1, "x") for r in texts], "lang string, text string, n int, phrase string").repartition(3)
    for most in (2000, 3):
        assert collected(C.ranked(C.frequencies(docs, weak=weak), most=most)) == brute(texts, most=most)


def test_nothing(spark, nothing):
    assert C.collocations(nothing).count() == 0 and C.collocations(nothing).columns == COLUMNS


def test_edges(spark, edges):
    rows = [(r.lang, r.text) for r in edges.collect()]
    assert collected(C.collocations(edges, least=2)) == brute(rows, least=2)


def test_products_beyond_64_bits(spark):
    f = {("en", ("a",)): 9 * 10**15, ("en", ("b",)): 7 * 10**14, ("en", ("c",)): 6 * 10**14 + 1, ("en", ("a", "b")): 6 * 10**14 + 4, ("en", ("b", "c")): 6 * 10**14, ("en", ("a", "b", "c")): 48 * 10**13 + 3}
    known = [(lang, " ".join(w), len(w), n) for (lang, w), n in f.items()] + [("en", None, 0, 10**17)]
    got = collected(C.ranked(spark.createDataFrame(known, "lang string, phrase string, words int, n long")))
    assert got == rank(f, {"en": 10**17}) and len(got) == 2  # b c lies in a b c


def test_words_that_begin_many_phrases(spark, monkeypatch):
    from pathgrade.llm import common

    monkeypatch.setattr(common, "UNEVEN_ROWS", 3)
    f = {("en", ("the",)): 5000} | {("en", (f"w{k}",)): 40 + k for k in range(50)} | {("en", ("the", f"w{k}")): 30 + k for k in range(50)}
    known = [(lang, " ".join(w), len(w), n) for (lang, w), n in f.items()] + [("en", None, 0, 9000)]
    assert collected(C.ranked(spark.createDataFrame(known, "lang string, phrase string, words int, n long"))) == rank(f, {"en": 9000})
