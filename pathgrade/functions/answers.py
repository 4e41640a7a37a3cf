"""What models answer: the JSON object in a text, scores and rationales in it. Fields need not be known beforehand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an object is found in a text, and what a score and a rationale must be.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FLAT = r"(\{[^{}]*\})"
LOWEST, HIGHEST, MISSING = 1, 4, 2
LEAST_RATIONALE = 40
RATING_MIDDLE = 4

WHOLE_NUMBER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def answer(text: Column) -> Column:
    """value (VARIANT) and where it was found: the whole text, a fenced block, flat braces; the first that is JSON.

    Both null where none is; the value of a whole text may be something other than an object.
    """
    tries = {"whole": F.regexp_replace(text, r"^\s+|\s+$", ""), "block": F.regexp_extract(text, FENCED, 1), "braces": F.regexp_extract(text, FLAT, 1)}
    out = F.lit(None).cast("struct<value:variant,found:string>")
    for name, t in reversed(tries.items()):
        value = F.try_parse_json(F.when(t != "", t))
        out = F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(name).alias("found"))).otherwise(out)
    return out


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def whole_number(value: Column) -> Column:
    """Numbers are cut to whole ones, texts must be whole numbers, true is 1 and false 0; else null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    said = F.when(text.rlike(WHOLE_NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double").cast("long"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), cut).when(kind == "STRING", said).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long"))


def score(value: Column, name: str) -> Column:
    """A field as a score from 1 to 4; what is no number, and what is not there, counts as 2."""
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.coalesce(whole_number(member(value, name)), F.lit(MISSING)))).cast("int")


def padded(text: Column, least: int = LEAST_RATIONALE) -> Column:
    """A text that is too short is filled up with dots."""
    return F.when(F.length(text) < least, F.rpad(text, least, ".")).otherwise(text)


def rationale(value: Column, name: str = "rationale", least: int = LEAST_RATIONALE) -> Column:
    """A field as a text, without space at its ends, filled up. Null is written ``None``, as truth values are capitalized."""
    field = member(value, name)
    kind = F.schema_of_variant(field)
    text = F.try_variant_get(field, "$", "string")
    said = F.when(field.isNull(), "").when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.coalesce(text, F.to_json(field)))
    return padded(F.regexp_replace(said, r"^\s+|\s+$", ""), least)


def scored(text: Column, dims: tuple[str, ...]) -> Column:
    """found, a score for each dimension, rationale, error: null scores and an error where a text has no object."""
    got = answer(text)
    value = got["value"]
    ok = F.schema_of_variant(value).startswith("OBJECT")
    error = F.when(value.isNull(), "no JSON object").when(~ok, "not an object")
    return F.struct(got["found"].alias("found"), *[F.when(ok, score(value, d)).alias(d) for d in dims], F.when(ok, rationale(value)).alias("rationale"), error.alias("error"))


def rating_to_reward(rating: Column) -> Column:
    """Ratings 0 to 8 as rewards -1 to 1."""
    return (rating - RATING_MIDDLE) / RATING_MIDDLE


def reward_to_rating(reward: Column) -> Column:
    return F.rint((reward + 1.0) * RATING_MIDDLE).cast("int")


def reward(value: Column, name: str) -> Column:
    """A field as a reward: a whole rating from 0 to 8 is decoded, a fraction is one already; else null."""
    field = member(value, name)
    kind, number = F.schema_of_variant(field), F.try_variant_get(field, "$", "double")
    return F.when((kind == "BIGINT") & number.between(0, 2 * RATING_MIDDLE), rating_to_reward(number)).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), number)


def judged(value: Column, criteria: tuple[str, ...], fallback: float) -> Column:
    """Each criterion cut to 0 to 1, and their mean (ensemble); if any is no number all are the fallback."""
    fields = {c: member(value, c) for c in criteria}
    numbers = {c: F.when(F.schema_of_variant(f).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(f, "$", "double")) for c, f in fields.items()}
    ok = reduce(lambda a, b: a & b, (n.isNotNull() for n in numbers.values()))
    cut = {c: F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))).otherwise(fallback) for c, n in numbers.items()}
    mean = reduce(lambda a, b: a + b, cut.values()) / len(cut)
    return F.struct(*[x.alias(c) for c, x in cut.items()], F.when(ok, mean).otherwise(fallback).alias("ensemble"))
