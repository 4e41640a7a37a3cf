"""Text functions: leaks, overlaps, topics, places, numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def has_pii(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text.rlike(K.EMAIL) | text.rlike(K.US_PHONE) | text.rlike(K.SSN)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def sentence_overlap(response: Column, source_words: Column) -> Column:
    sentences = F.filter(F.transform(F.split(F.coalesce(response, F.lit("")), r"[.!?]"), F.trim), lambda s: F.length(s) > 0)
    hits = F.filter(sentences, lambda s: F.arrays_overlap(F.split(F.lower(s), r"\s+"), source_words))
    return F.when(F.size(sentences) == 0, 1.0).otherwise(F.size(hits) / F.size(sentences))


def topic(text: Column) -> Column:
    """The topic of whose keywords the text contains most (as parts of words too); ties go to the first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = {t: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for t, words in K.TOPIC_KEYWORDS.items()}
    most = F.greatest(*score.values())
    out = F.when(most == 0, "general_task")
    for t, s in score.items():
        out = out.when(s == most, t)
    return out


def keywords_in(text: Column, words: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(words, lambda w: low.contains(w))


def valid_place(lat: Column, lon: Column) -> Column:
    """A place on earth that is not the null island."""
    bad = F.isnan(lat) | F.isnan(lon) | (F.abs(lat) > 90) | (F.abs(lon) > 180) | ((lat == 0) & (lon == 0))
    return lat.isNotNull() & lon.isNotNull() & ~bad


def place_or(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """lat, lon, kept: the place if it is valid, else the other one (a scenario's centre)."""
    ok = valid_place(lat, lon)
    return F.struct(F.when(ok, lat).otherwise(other_lat).alias("lat"), F.when(ok, lon).otherwise(other_lon).alias("lon"), ok.alias("kept"))


def outcome_name(action: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in K.OUTCOMES.items() for x in kv])[action]


def thresholds(spec: Column) -> Column:
    """'k=v,k=v' as a map of numbers."""
    pairs = F.transform_keys(F.str_to_map(spec, F.lit(","), F.lit("=")), lambda k, _: F.trim(k))
    return F.transform_values(pairs, lambda _, v: F.trim(v).cast("double"))


def four_digits(x: Column) -> Column:
    """A number in four significant digits, ties to even, without zeros at the end."""
    x = x.cast("double")
    unit = F.pow(F.lit(10.0), 3 - F.floor(F.log10(F.abs(x))))
    even = F.when(x == 0, x).otherwise(F.rint(x * unit) / unit)
    plain = F.regexp_replace(F.format_string("%.4g", even), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(x.isNotNull(), F.regexp_replace(plain, r"\.(e|$)", "$1"))
