import re
from collections import Counter

import numpy as np

from pathgrade.llm import quality

TEXTS = ["a b c a b c a b c", "x\ny\nx\n \n \nx", "#$% | <b> &", "one two three one two three", "a b a b a b", "é è ê", "", None, "w " * 80, "a  b\tc d\u0085e"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_statistics_and_edges(spark, edges, nothing):
    docs = edges.unionByName(spark.createDataFrame([(k + 100, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r
        assert not (r.kept and r.base_failed)
    assert quality.quality(nothing).count() == 0


def test_outliers_go_and_clean_stay(spark):
    rows = spark.range(600).selectExpr("id as doc_id", "case when id % 60 = 7 then concat_ws(' ', transform(sequence(1, 90), i -> concat(md5(concat(id, i)), '#$%'))) else concat_ws(' ', transform(sequence(1, int(80 + id % 40)), i -> substr(md5(concat(id, ':', i)), 1, int(3 + (id + i) % 5)))) end as text", "'en' as lang", "concat('s', id % 2) as source")
    got = {r.doc_id: r.kept for r in quality.quality(rows).collect()}
    assert all(kept == (k % 60 != 7) for k, kept in got.items())
    names = ["__w", "scale", "m0", "v00", "__row_of_docs", "cutoff"]
    kept = quality.keep_good(rows.withColumns({n: rows.doc_id for n in names}))
    assert kept.columns == ["doc_id", "text", "lang", "source", *names] and kept.count() == 590
    assert all(r[n] == r.doc_id for r in kept.collect() for n in names)


def robust(x, floors, share=0.75):
    """The best of many random starts, each concentrated until it settles: log determinant, mean, covariance."""
    rng, best = np.random.default_rng(3), None
    h = int(np.ceil(share * len(x)))
    for _ in range(200):
        own = rng.choice(len(x), 12, replace=False)
        for _ in range(30):
            m, c = x[own].mean(0), np.cov(x[own].T, bias=True) + np.diag(floors**2)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = np.argsort(d, kind="stable")[:h]
        m, c = x[own].mean(0), np.cov(x[own].T, bias=True) + np.diag(floors**2)
        det = np.linalg.slogdet(c)[1]
        best = min(best or (det, m, c), (det, m, c), key=lambda z: z[0])
    return best


def test_smallest_determinant(spark):
    """Correlated statistics with a fifth of the rows elsewhere: no search of random starts finds a smaller determinant."""
    rng = np.random.default_rng(8)
    floors = np.array([f for _, _, f in quality.VECTOR])
    mix = rng.standard_normal((5, 5)) * floors
    x = rng.standard_normal((800, 5)) @ mix.T * 3 + 4
    x[:160] = rng.standard_normal((160, 5)) * floors * 0.2 + 4 + 30 * floors * np.sign(mix.sum(1))
    frame = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "__lang string, __src string, " + ", ".join(f"{c} double" for c in quality.X))
    est = quality.mcd(frame)[0].first()
    det, mean, cov = robust(x, floors)
    assert est["log_det"] <= det + 0.05 and np.allclose([est[f"m{i}"] for i in range(5)], mean, atol=0.3 * floors.max())
    got = np.array([[est[f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
    assert abs(np.linalg.slogdet(got)[1] - est["log_det"]) < 1e-6


def test_cutoff():
    """Five dimensions: known quantiles of the chi-square distribution."""
    assert abs(quality.chi_square_quantile(0.05) - 11.0705) < 1e-3 and abs(quality.chi_square_quantile(0.001) - 20.515) < 1e-3


def test_mostly_repeated_short_lines_are_rejected(spark):
    """Both pass the base rules."""
    word = lambda a, b: "".join(chr(97 + (a * 7 + b * 11 + k * (a + 3 * b)) % 26) for k in range(3 + (a + b) % 5))
    rows = [(k, "\n".join(" ".join(word(k, 9 * line + i) for i in range(9)) for line in range(12)), "en", "s") for k in range(400)]
    menu = "\n".join(["home about"] * 60 + [" ".join(word(7, 5 * line + i) for i in range(8)) for line in range(4)])
    rows.append((1000, menu, "en", "s"))
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000].kept and sum(r.kept for r in got.values()) >= 396


def test_small_source_is_judged_by_its_own_documents(spark):
    short = "concat_ws(' ', transform(sequence(1, int(80 + id % 40)), i -> substr(md5(concat(id, ':', i)), 1, int(3 + (id + i) % 5))))"
    long = "concat_ws(' ', transform(sequence(1, int(80 + id % 40)), i -> substr(md5(concat(id, ':', i)), 1, int(18 + (id + i) % 5))))"
    junk = "concat_ws(' ', transform(sequence(1, 90), i -> concat(substr(md5(concat(id, i)), 1, 18), '#$%')))"
    rows = spark.range(640).selectExpr(
        "id as doc_id",
        f"case when id < 600 then {short} when id in (611, 622) then {junk} else {long} end as text",
        "'en' as lang",
        "case when id < 600 then 'large' else 'small' end as source",
    )
    got = {r.doc_id: r.kept for r in quality.quality(rows).collect()}
    assert {k for k, kept in got.items() if not kept} == {611, 622}


def verdicts(groups, prior=quality.PRIOR_ROWS):
    """(lang, source) -> vectors of documents that pass the base rules: squared distance and cutoff of each, from the definition."""
    floors = np.array([f for _, _, f in quality.VECTOR])
    own = {}
    for key, x in groups.items():
        _, m, c = robust(x, floors)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        own[key] = (len(x), m, c * max(1.0, np.sort(d)[int(np.ceil(0.5 * len(x))) - 1] / quality.MEDIAN_CHI2))

    def pooled(parts):
        n = sum(k for k, _, _ in parts)
        m = sum(k * m for k, m, _ in parts) / n
        return n, m, sum(k * (c + np.outer(mean, mean)) for k, mean, c in parts) / n - np.outer(m, m)

    def mixed(a, b):
        w = a[0] / (a[0] + prior)
        return 1 / (w * w / a[0] + (1 - w) ** 2 / b[0]), w * a[1] + (1 - w) * b[1], w * a[2] + (1 - w) * b[2]

    every = pooled([pooled([e for (k, _), e in own.items() if k == lang]) for lang in {k for k, _ in own}])
    out = {}
    for (lang, source), x in groups.items():
        others = [e for (k, s), e in own.items() if k == lang and s != source]
        n, m, c = mixed(own[lang, source], mixed(pooled(others), every) if others else every)
        n = max(n, 10)
        cutoff = quality.chi_square_quantile(quality.TAIL) * (n * n - 1) / (n * (n - 5))
        out[lang, source] = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), cutoff
    return out


def test_verdicts_from_the_definition(spark):
    """Three sources of two languages: estimate, mixture, distance and cutoff on arrays give the same rows to keep."""
    rng = np.random.default_rng(12)
    rows, vectors = [], {}
    for lang, source, n, size in (("en", "a", 300, 6), ("en", "b", 120, 9), ("de", "a", 200, 7)):
        for k in range(n):
            junk = k % 20 == 3
            letters = lambda m: "".join(chr(97 + x) for x in rng.integers(0, 26, m))
            words = [letters(max(1, int(rng.poisson(size)))) + ("#$" if junk and rng.random() < 0.6 else "") for _ in range(int(60 + rng.integers(0, 200)))]
            lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
            if k % 7 == 0:
                lines += lines[:1]
            text = "\n".join(lines)
            w, c, s, d, r, failed = brute(text)
            if not failed:
                x = [np.log(w), np.log(c / w), np.sqrt(s / c), np.sqrt(max(d - 1, 0) / max(len(lines), 1)), np.sqrt(max(r - quality.SAID_TWICE, 0) / w)]
                vectors.setdefault((lang, source), []).append((len(rows), x))
            rows.append((len(rows), text, lang, source))
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    found = verdicts({k: np.array([x for _, x in v]) for k, v in vectors.items()})
    checked = gone = 0
    for key, v in vectors.items():
        d, cutoff = found[key]
        for (doc_id, _), distance in zip(v, d):
            if not 0.8 < distance / cutoff < 1.25:  # subsets of bins and of sorted rows differ a little
                assert got[doc_id].kept == (distance <= cutoff), (key, distance, cutoff, got[doc_id].distance)
                checked, gone = checked + 1, gone + (distance > cutoff)
    assert checked > 550 and gone >= 25 and checked > 0.95 * sum(map(len, vectors.values()))


def test_sources_that_are_all_junk(spark):
    """A few rows of junk are outliers of their language; two dozen are a source with ways of its own, as the README says."""
    word = "substr(md5(concat(id, ':', i)), 1, int(3 + (id + i) % 5))"
    clean = f"concat_ws(' ', transform(sequence(1, int(80 + id % 40)), i -> {word}))"
    junk = f"concat_ws(' ', transform(sequence(1, 90), i -> concat({word}, '#$%')))"
    sizes = {"de": 1, "en": 2, "es": 5, "fr": 24}
    rows = spark.range(4 * 200).selectExpr("id as doc_id", f"{clean} as text", "element_at(array('de', 'en', 'es', 'fr'), int(1 + id % 4)) as lang", "if(id % 8 < 4, 'a', 'b') as source")
    for k, (lang, n) in enumerate(sizes.items()):
        more = spark.range(10_000 + 100 * k, 10_000 + 100 * k + n).selectExpr("id as doc_id", f"{junk} as text", f"'{lang}' as lang", "'junk' as source")
        rows = rows.unionByName(more)
    got = {r.doc_id: r for r in quality.quality(rows).collect()}
    assert all(r.kept for k, r in got.items() if k < 10_000)
    kept = [sum(r.kept for k, r in got.items() if k >= 10_000 and (k - 10_000) // 100 == n) for n in range(4)]
    assert kept == [0, 0, 0, 24], kept
