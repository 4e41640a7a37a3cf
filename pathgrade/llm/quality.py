"""Quality rules: base rules, and robust multivariate outliers by language and source. DataFrame operations only.

Each document has a vector of transformed statistics (VECTOR). For each language and source the mean and covariance of
the documents that pass the base rules are estimated by minimum covariance determinant: of the subsets of a
``kept_share`` of the documents, one whose covariance has the smallest determinant. Three deterministic starts (medians
and deviations; the correlations of clipped scores; those of directions) take two concentration steps each, in which
the documents with the smallest distances give the next estimate; the start with the smallest determinant goes on until
its determinant no longer falls. Determinants are those of regularized covariances: each variance has a floor added, in
units in which a difference means something, so a statistic that is 0 almost everywhere does not make the determinant 0
and every other value an outlier.

A group of n documents is then judged by a mean and a covariance that are n parts its own and ``prior_rows`` parts its
language's (those of a language, pooled from its other groups, are mixed likewise with those of all documents), so no row
count switches estimates. How far the two means lie apart does not widen the covariance: a few rows far from their language are
outliers, many are a source with ways of its own. A document is rejected if its squared Mahalanobis distance is over the chi-square quantile that one ordinary
document in 1 / ``tail`` exceeds, times the factor that an estimate from so many rows needs.

Quantiles come from counts in fixed bins, so no group's values meet in one task and reruns agree.

Null texts have no words and fail the base rules; so do empty texts. Null languages and sources are groups. Repeated
rows count each. Without documents that pass the base rules there are no estimates and nothing more is rejected. The
documents' other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, is_small, join_dimension, materialize, only_last_stays, packed_rows, unpacked_rows

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEPT_SHARE = 0.75
#: Concentration steps of every start, and at most of the one that goes on.
FIRST_STEPS, MOST_STEPS = 2, 8
#: Determinants that fall by a smaller share of themselves have settled (bins of distances make them no finer).
SETTLED = 1e-3
#: The language's estimate counts as so many rows beside a group's own: two for each statistic.
PRIOR_ROWS = 10
#: One repeated line is no sign, however short the text, and so are the words that a sentence said twice takes.
SAID_TWICE = 20
#: Name, transformation, floor. Six floors from the centre are an outlier by themselves: texts 36 times as long or
#: short, words twice as long, 6 % more symbols, four fifths of the lines duplicates, 43 % of the words in repeats.
VECTOR = (
    ("log_words", lambda w, c, s, d, r, n: F.log(w), 0.6),
    ("mean_word", lambda w, c, s, d, r, n: F.log(c / w), 0.12),
    ("symbols", lambda w, c, s, d, r, n: F.sqrt(s / c), 0.042),
    ("dup_lines", lambda w, c, s, d, r, n: F.sqrt(F.greatest(d - 1, F.lit(0.0)) / F.greatest(n, F.lit(1))), 0.15),
    ("repeats", lambda w, c, s, d, r, n: F.sqrt(F.greatest(r - SAID_TWICE, F.lit(0.0)) / w), 0.11),
)
#: The chi-square distribution's median for five dimensions, and the share of ordinary documents over the cutoff.
MEDIAN_CHI2 = 4.351
TAIL = 1e-6
#: Squared distances are counted in this many bins for each factor of e.
BINS = 64
P = len(VECTOR)
X = [f"__x{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """The rows with __w (words), __c, __s, __d, __r (the base statistics) and __n (lines with a word)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    out = out.withColumn("__w", F.size("__words").cast("long"))
    # windows of three words: upper 32 bits of a hash, then the place; equal hashes stand together once sorted
    out = out.withColumn(
        "__grams",
        F.expr("if(__w < 4, array(), sort_array(transform(sequence(0L, __w - 3), i -> shiftleft(xxhash64(__words[int(i)], __words[int(i + 1)], __words[int(i + 2)]), 32) | i)))"),
    )
    out = out.withColumn(
        "__maybe",
        F.expr("filter(__grams, (x, k) -> (k > 0 and shiftright(__grams[k - 1], 32) = shiftright(x, 32)) or (k < size(__grams) - 1 and shiftright(__grams[k + 1], 32) = shiftright(x, 32)))"),
    )
    # only these are compared as text
    out = out.withColumn(
        "__exact",
        F.expr("if(size(__maybe) = 0, cast(array() as array<struct<g:string,i:int>>), sort_array(transform(__maybe, x -> named_struct('g', concat_ws(' ', __words[int(x & 4294967295L)], __words[int(x & 4294967295L) + 1], __words[int(x & 4294967295L) + 2]), 'i', int(x & 4294967295L)))))"),
    )
    out = out.withColumn("__twice", F.expr("transform(filter(__exact, (x, k) -> (k > 0 and __exact[k - 1].g = x.g) or (k < size(__exact) - 1 and __exact[k + 1].g = x.g)), x -> x.i)"))
    repeats = F.expr("if(size(__twice) = 0, 0, size(array_distinct(flatten(transform(__twice, i -> array(i, i + 1, i + 2))))))")
    return (
        out.withColumn("__c", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("__s", F.coalesce(F.regexp_count(F.col("text"), F.lit(SYMBOL)), F.lit(0)).cast("long"))
        .withColumn("__n", F.size("__lines").cast("long"))
        .withColumn("__d", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__r", repeats.cast("long"))
        .drop("__words", "__lines", "__grams", "__maybe", "__exact", "__twice")
    )


def with_vector(measured: DataFrame) -> DataFrame:
    """Adds __failed (the base rules) and the vector."""
    out = measured.withColumn("__failed", (F.col("__w") < MIN_WORDS) | (100 * F.col("__r") > MAX_REPEAT_PERCENT * F.col("__w")))
    parts = [F.col(c).cast("double") for c in ("__w", "__c", "__s", "__d", "__r", "__n")]
    safe = [F.greatest(parts[0], F.lit(1.0)), F.greatest(parts[1], F.lit(1.0)), *parts[2:]]
    return out.withColumns({x: f(*safe) for x, (_, f, _) in zip(X, VECTOR, strict=True)})


def chi_square_quantile(tail: float) -> float:
    """The value that a chi-square number of five dimensions exceeds with this probability."""
    over = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) > tail else (low, mid)
    return high


KEYS = ["__lang", "__src"]
STARTS = 3


def _quantile(values: DataFrame, keys: list[str], bin_: str, share: float, top: str) -> DataFrame:
    """Of each group, the upper edge number of the bin in which the quantile lies."""
    counts = values.groupBy(*keys, bin_).agg(F.count("*").alias("__k"))
    over = Window.partitionBy(*keys).orderBy(bin_)
    all_of = Window.partitionBy(*keys)
    cum = counts.withColumn("__cum", F.sum("__k").over(over)).withColumn("__all", F.sum("__k").over(all_of))
    return cum.where(F.col("__cum") >= F.ceil(F.col("__all") * share)).groupBy(*keys).agg(F.min(bin_).alias(top), F.first("__all").alias("__rows"))


MOMENTS = [*[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in LOWER]]
PARAMS = [*[f"m{i}" for i in range(P)], *[f"v{i}{j}" for i, j in LOWER]]


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances with floors (lower triangle), of each group."""
    aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    aggs += [F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in LOWER]
    est = rows.groupBy(*keys).agg(*aggs)
    return est.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + F.lit(VECTOR[i][2] ** 2) for i in range(P)})


def _inverted(est: DataFrame) -> DataFrame:
    """Adds the inverse of the covariances' lower triangle, and the determinant's logarithm."""
    for i, j in LOWER:  # Cholesky
        inner = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(F.col(f"c{i}{i}") - inner, F.lit(1e-12))) if i == j else (F.col(f"c{i}{j}") - inner) / F.col(f"l{j}{j}"))
    est = est.withColumn("log_det", 2 * sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))
    for j in range(P):  # its inverse
        for i in range(j, P):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0))
            est = est.withColumn(f"v{i}{j}", (F.lit(1.0 if i == j else 0.0) - inner) / F.col(f"l{i}{i}"))
    return est.drop(*[f"l{i}{j}" for i, j in LOWER])


def _mixed(own: str, wide: str, prior_rows: float) -> Column:
    """The moments between those of two estimates, by rows; those of one if the other is null.

    ``rows`` becomes the number of rows whose mean would be as sure as the mixture's.
    """
    a, b = F.col(own), F.col(wide)
    w = a["rows"] / (a["rows"] + F.lit(float(prior_rows)))
    parts = [(w * a[c] + (1 - w) * b[c]).alias(c) for c in MOMENTS]
    sure = 1 / (w * w / a["rows"] + (1 - w) * (1 - w) / b["rows"])
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(sure.alias("rows"), *parts))


def _without(all_: str, own: str) -> Column:
    """A pooled estimate less one of its parts; null if nothing is left."""
    a, b = F.col(all_), F.col(own)
    rows = a["rows"] - b["rows"]
    mean = [(a["rows"] * a[f"m{i}"] - b["rows"] * b[f"m{i}"]) / rows for i in range(P)]
    square = lambda e, i, j: e["rows"] * (e[f"c{i}{j}"] + e[f"m{i}"] * e[f"m{j}"])
    parts = [m.alias(f"m{i}") for i, m in enumerate(mean)]
    parts += [((square(a, i, j) - square(b, i, j)) / rows - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in LOWER]
    return F.when(b.isNull(), a).when(rows > 0.5, F.struct(rows.alias("rows"), *parts))


def _distance() -> Column:
    z = [sum((F.col(f"v{i}{j}") * (F.col(X[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((x * x for x in z), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.ceil(F.log(d2 + 1e-9) * BINS).cast("int")


def _starts(rows: DataFrame) -> tuple[DataFrame, bool]:
    """lang, source, start: the first estimates. Whether there are few groups."""
    each = [*KEYS, "__f"]
    # medians and median deviations, in bins of an eighth of a floor; all statistics at once
    width = F.element_at(F.array(*[F.lit(v[2] / 8) for v in VECTOR]), F.col("__f") + 1)
    long = rows.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(i).alias("__f"), F.col(x).alias("__v")) for i, x in enumerate(X)])).alias("__z")).select(*KEYS, "__z.*")
    mid = _quantile(long.withColumn("__b", F.round(F.col("__v") / width).cast("int")), each, "__b", 0.5, "__top")
    mid = materialize(mid.select(*each, (F.col("__top") * width).alias("__m")), "mcd-median")
    few = is_small(mid)
    off = join_dimension(long, mid, each, small=few).withColumn("__b", F.round(F.abs(F.col("__v") - F.col("__m")) / width).cast("int"))
    dev = _quantile(off, each, "__b", 0.5, "__top").select(*each, F.greatest(F.col("__top") * width * 1.4826, width * 8).alias("__s"))
    both = join_dimension(dev, mid, each, small=few)
    at = lambda c, i: F.max(F.when(F.col("__f") == i, F.col(c)))
    centre = both.groupBy(*KEYS).agg(*[at("__m", i).alias(f"m{i}") for i in range(P)], *[at("__s", i).alias(f"s{i}") for i in range(P)])
    centre = materialize(centre, "mcd-centre")
    # correlations of scores clipped by tanh, and of directions
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    near = join_dimension(rows, centre, KEYS, small=few).select(*KEYS, *[x.alias(f"z{i}") for i, x in enumerate(z)])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-12)))
    kinds = {"t": lambda i: F.tanh(f"z{i}"), "d": lambda i: F.col(f"z{i}") / size}
    near = near.withColumns({f"{k}{i}": f(i) for k, f in kinds.items() for i in range(P)})
    found = near.groupBy(*KEYS).agg(*[F.covar_pop(f"{k}{i}", f"{k}{j}").alias(f"{k}{i}{j}") for k in kinds for i, j in LOWER])
    found = join_dimension(centre, found, KEYS, small=few)
    # a correlation of something that does not vary is 0; nine tenths of it keep the matrix well conditioned
    rho = lambda k, i, j: F.lit(0.0) if k is None else 0.9 * F.coalesce(F.try_divide(F.col(f"{k}{i}{j}"), F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}"))), F.lit(0.0))
    cov = lambda k, i, j: (F.col(f"s{i}") * F.col(f"s{i}") if i == j else rho(k, i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}")
    starts = [F.struct(F.lit(n).alias("__start"), *[cov(k, i, j) for i, j in LOWER]) for n, k in enumerate((None, *kinds))]
    est = found.select(*KEYS, *[f"m{i}" for i in range(P)], F.explode(F.array(*starts)).alias("__e")).select(*KEYS, "__e.__start", *[f"m{i}" for i in range(P)], *[f"__e.c{i}{j}" for i, j in LOWER])
    return materialize(_inverted(est).select(*KEYS, "__start", *MOMENTS, *PARAMS[P:], "log_det"), "mcd-start"), few


def _concentrate(rows: DataFrame, est: DataFrame, keys: list[str], kept_share: float, few: bool) -> DataFrame:
    """One step: the ``kept_share`` of each group's rows with the smallest distances gives the next estimate."""
    near = join_dimension(rows, est, KEYS, small=few).withColumn("__b", _bin(_distance())).select(*keys, *X, "__b")
    limit = _quantile(near, keys, "__b", kept_share, "__top").select(*keys, "__top")
    est = _inverted(_estimate(join_dimension(near, limit, keys, small=few).where("__b <= __top"), keys))
    return materialize(est.select(*keys, *MOMENTS, *PARAMS[P:], "log_det"), "mcd-step")


def mcd(rows: DataFrame, kept_share: float = KEPT_SHARE) -> tuple[DataFrame, bool]:
    """lang, source -> mean, covariance, its inverse and log determinant of the subset found; whether there are few groups."""
    est, few = _starts(rows)
    own = [*KEYS, "__start"]
    for _ in range(FIRST_STEPS):
        est = _concentrate(rows, est, own, kept_share, few)
    names = [*MOMENTS, *PARAMS[P:]]
    best = est.groupBy(*KEYS).agg(F.min(F.struct(F.round("log_det", 6).alias("det"), "__start", F.struct(*names, "log_det").alias("e"))).alias("b"))
    est = materialize(best.select(*KEYS, "b.e.*"), "mcd-best")
    for _ in range(MOST_STEPS):
        after = _concentrate(rows, est.select(*KEYS, *names, "log_det"), KEYS, kept_share, few)
        both = join_dimension(after, est.select(*KEYS, F.struct(*names, "log_det").alias("old")), KEYS, small=few)
        better, fell = F.col("log_det") < F.col("old.log_det"), F.col("old.log_det") - F.col("log_det") > SETTLED
        both = both.select(*KEYS, fell.alias("fell"), *[F.when(better, F.col(c)).otherwise(F.col("old")[c]).alias(c) for c in (*names, "log_det")])
        est = materialize(both, "mcd-better")
        if est.where("fell").isEmpty():
            break
    return est.drop("fell"), few


def _pooled(est: DataFrame, keys: list[str]) -> DataFrame:
    """The mixture of estimates (column e) by rows, by keys."""
    rows = F.sum("e.rows")
    mean = est.groupBy(*keys).agg(rows.alias("rows"), *[(F.sum(F.col("e.rows") * F.col(f"e.m{i}")) / rows).alias(f"m{i}") for i in range(P)], *[
        (F.sum(F.col("e.rows") * (F.col(f"e.c{i}{j}") + F.col(f"e.m{i}") * F.col(f"e.m{j}"))) / rows).alias(f"c{i}{j}") for i, j in LOWER
    ])
    mean = mean.where("rows > 0").withColumns({f"c{i}{j}": F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in LOWER})
    return mean.select(*keys, F.struct("rows", *MOMENTS).alias("e"))


def fit(measured: DataFrame, kept_share: float = KEPT_SHARE, prior_rows: float = PRIOR_ROWS, tail: float = TAIL) -> DataFrame:
    """lang, source -> the estimate that judges the group, and its cutoff. Only this table stays of those written."""
    with only_last_stays(measured.sparkSession):
        return _fit(measured, kept_share, prior_rows, tail)


def _fit(measured: DataFrame, kept_share: float, prior_rows: float, tail: float) -> DataFrame:
    group = [F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__src")]
    rows = materialize(measured.where(~F.col("__failed")).select(*group, *X), "mcd-rows")
    est, few = mcd(rows, kept_share)
    # the subset's covariance is too small: it is scaled by the distances' median (never below the floors' own scale)
    near = join_dimension(rows, est, KEYS, small=few).withColumn("__b", _bin(_distance()))
    mid = _quantile(near, KEYS, "__b", 0.5, "__top").select(*KEYS, F.greatest(F.lit(1.0), F.exp(F.col("__top") / BINS) / MEDIAN_CHI2).alias("scale"), "__rows")
    est = join_dimension(est, mid, KEYS, small=few).withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * F.col("scale") for i, j in LOWER})
    est = materialize(est.select(*KEYS, F.struct(F.col("__rows").cast("double").alias("rows"), *MOMENTS).alias("e")), "mcd-final")
    # each language and source mixes its own estimate with its language's, and that with the one of all documents
    language = materialize(_pooled(est, ["__lang"]), "mcd-language")
    every = _pooled(language, [])
    found = materialize(measured.select(*group).distinct(), "mcd-found")
    found = join_dimension(found, est.withColumnRenamed("e", "e2"), KEYS, "left", few)
    found = join_dimension(found, language.withColumnRenamed("e", "e1"), ["__lang"], "left", few)
    found = found.join(F.broadcast(every.withColumnRenamed("e", "e0")), F.lit(True), "left")  # one row
    # one after the other: each expression refers to columns, not to the expression before
    found = materialize(found.select("__lang", "__src", "e2", "e0", _without("e1", "e2").alias("e1")), "mcd-others")
    found = materialize(found.select("__lang", "__src", "e2", _mixed("e1", "e0", prior_rows).alias("e")), "mcd-wide")
    found = materialize(found.select("__lang", "__src", _mixed("e2", "e", prior_rows).alias("e")), "mcd-blend")
    n = F.greatest(F.col("e.rows"), F.lit(2.0 * P))
    found = found.withColumn("cutoff", F.lit(chi_square_quantile(tail)) * (n * n - 1) / (n * (n - P)))
    found = materialize(found.select("__lang", "__src", "cutoff", "e.*"), "mcd-mixed")
    return materialize(_inverted(found).select("__lang", "__src", *PARAMS, "cutoff"), "mcd-groups")


def judge(measured: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds __distance (squared; null without an estimate) and __kept."""
    rows = measured.withColumn("__lang", F.col("lang").cast("string")).withColumn("__src", F.col("source").cast("string"))
    rows = join_dimension(rows, groups, ["__lang", "__src"], "left")
    rows = rows.withColumn("__distance", _distance())
    kept = ~F.col("__failed") & ~F.coalesce(F.col("__distance") > F.col("cutoff"), F.lit(False))
    return rows.withColumn("__kept", kept).drop("__lang", "__src", *PARAMS, "cutoff")


def quality(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept, distance."""
    rows = materialize(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-statistics")
    rows = with_vector(rows)
    out = judge(rows, fit(rows, **options))
    return out.select(
        "doc_id",
        F.col("__w").alias("n_words"),
        F.col("__c").alias("word_chars"),
        F.col("__s").alias("n_symbols"),
        F.col("__d").alias("n_dup_lines"),
        F.col("__r").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.col("__distance").alias("distance"),
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that are kept, with their own columns. Texts are measured once, beside their rows, and not shuffled."""
    whole, names = packed_rows(docs)
    rows = with_vector(materialize(statistics(docs.select(whole, "text", "lang", "source")).drop("text"), "quality-statistics"))
    groups = fit(rows.drop(ROW), **options)
    return unpacked_rows(judge(rows, groups).where("__kept"), names)
