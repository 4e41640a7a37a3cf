"""JSON Schema compiled to a column: every violation of a record, with its path.

``compiled`` turns a schema (draft 7) into one expression over a VARIANT column: an array of (path, rule), empty for a
valid record. Objects, arrays and their members are followed as deep as the schema goes; records need no Spark schema,
and keys that the schema does not know are seen. Rules: type (a name or a list of names), enum, const, pattern (found
anywhere), format (date-time), minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf,
minItems, maxItems, items (one schema), required, properties, additionalProperties, minProperties, maxProperties, allOf,
anyOf, oneOf, not, if/then/else, and the schemas true and false. Other keywords of validation are an error when the
schema is compiled, so that nothing passes unchecked; what only annotates (titles, examples, own sections) is skipped.

Rules hold for values of their type only, as the draft has it: a minimum does not apply to a string.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<path:string,rule:string>>"
NOT_DONE = ("$ref", "patternProperties", "propertyNames", "dependencies", "contains", "additionalItems", "uniqueItems")
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
FORMATS = {"date-time": DATE_TIME}


def _get(value: Column, key: str) -> Column:
    """A member; null if there is none."""
    if "'" in key or "\\" in key:
        raise ValueError(f"a property's name may not have quotes: {key!r}")
    return F.try_variant_get(value, f"$['{key}']", "variant")


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


class _Value:
    """A value and what it is. ``kind`` is Spark's name of its type."""

    def __init__(self, value: Column, path: Column, kind: Column | None = None) -> None:
        self.value, self.path = value, path
        self.kind = F.schema_of_variant(value) if kind is None else kind
        self.number = self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        self.string, self.object, self.array = self.kind == "STRING", self.kind.startswith("OBJECT<"), self.kind.startswith("ARRAY<")

    def is_a(self, name: str) -> Column:
        whole = self.number & (_as(self.value, "double") == F.floor(_as(self.value, "double")))
        return {"string": self.string, "object": self.object, "array": self.array, "boolean": self.kind == "BOOLEAN", "null": self.kind == "VOID", "number": self.number, "integer": whole}[name]

    def equals(self, what) -> Column:
        if what is None:
            return self.kind == "VOID"
        if isinstance(what, bool):
            return (self.kind == "BOOLEAN") & (_as(self.value, "boolean") == F.lit(what))
        if isinstance(what, (int, float)):
            return self.number & (_as(self.value, "double") == F.lit(float(what)))
        if isinstance(what, str):
            return self.string & (_as(self.value, "string") == F.lit(what))
        raise ValueError(f"enum and const take single values: {what!r}")

    def broken(self, rule: str, applies: Column | None, ok: Column) -> Column:
        """What is found if the rule applies and does not hold."""
        bad = ~F.coalesce(ok, F.lit(False))
        bad = bad if applies is None else applies & bad
        return F.when(bad, F.array(F.struct(self.path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(FOUND))


def _valid(found: Column) -> Column:
    return F.size(found) == 0


def _checked(schema: dict | bool, value: Column, path: Column) -> Column:
    """What is found in a value that is there. The value and its kind are found once, as a list of one, for all of its rules."""
    one = F.array(F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind")))
    return F.flatten(F.transform(one, lambda v: _joined(_rules(schema, v["value"], path, v["kind"]))))


def _rules(schema: dict | bool, value: Column, path: Column, kind: Column) -> list[Column]:
    """For a value that is there: arrays of what is found."""
    at = _Value(value, path, kind)
    if schema is True:
        return []
    if schema is False:
        return [at.broken("forbidden", None, F.lit(False))]
    if bad := [k for k in NOT_DONE if k in schema] or ([k for k in ("items",) if isinstance(schema.get(k), list)]):
        raise ValueError(f"not done: {', '.join(bad)}")
    out = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = at.is_a(kinds[0])
        for k in kinds[1:]:
            ok = ok | at.is_a(k)
        out.append(at.broken("type", None, ok))
    for rule, choices in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if choices is not None:
            texts = [c for c in choices if isinstance(c, str)]
            ok = at.string & _as(value, "string").isin(texts) if texts else F.lit(False)
            for c in choices:
                ok = ok if isinstance(c, str) else F.coalesce(ok, F.lit(False)) | at.equals(c)
            out.append(at.broken(rule, None, ok))
    text, number = _as(value, "string"), _as(value, "double")
    members, items = _as(value, "map<string,variant>"), _as(value, "array<variant>")
    bounds = {
        "minLength": (at.string, lambda n: F.length(text) >= n),
        "maxLength": (at.string, lambda n: F.length(text) <= n),
        "pattern": (at.string, lambda p: text.rlike(p)),
        "minimum": (at.number, lambda n: number >= float(n)),
        "maximum": (at.number, lambda n: number <= float(n)),
        "exclusiveMinimum": (at.number, lambda n: number > float(n)),
        "exclusiveMaximum": (at.number, lambda n: number < float(n)),
        "multipleOf": (at.number, lambda n: number / float(n) == F.round(number / float(n))),
        "minItems": (at.array, lambda n: F.size(items) >= n),
        "maxItems": (at.array, lambda n: F.size(items) <= n),
        "minProperties": (at.object, lambda n: F.size(members) >= n),
        "maxProperties": (at.object, lambda n: F.size(members) <= n),
    }
    out += [at.broken(k, applies, ok(schema[k])) for k, (applies, ok) in bounds.items() if k in schema]
    if schema.get("format") in FORMATS:
        out.append(at.broken("format", at.string, text.rlike(FORMATS[schema["format"]])))
    below = lambda key: F.concat(path, F.lit(f".{key}"))
    for key in schema.get("required", []):
        missing = _Value(value, below(key), kind).broken("required", at.object, _get(value, key).isNotNull())
        out.append(missing)
    known = schema.get("properties", {})
    for key, sub in known.items():
        member = _get(value, key)
        if sub is not True:
            out.append(F.when(at.object & member.isNotNull(), _checked(sub, member, below(key))).otherwise(F.array().cast(FOUND)))
    more = schema.get("additionalProperties", True)
    if more is not True:
        others = F.filter(F.map_keys(members), lambda k: ~k.isin(list(known)) if known else F.lit(True))
        name = lambda k: F.concat(path, F.lit("."), k)
        if more is False:
            each = F.transform(others, lambda k: F.struct(name(k).alias("path"), F.lit("additionalProperties").alias("rule")))
        else:
            each = F.flatten(F.transform(others, lambda k: _checked(more, F.element_at(members, k), name(k))))
        out.append(F.when(at.object, each).otherwise(F.array().cast(FOUND)))
    if schema.get("items", True) is not True:
        each = F.transform(items, lambda x, i: _checked(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.when(at.array, F.flatten(each)).otherwise(F.array().cast(FOUND)))
    choices = {k: [_joined(_rules(s, value, path, kind)) for s in schema[k]] for k in ("allOf", "anyOf", "oneOf") if k in schema}
    out += choices.get("allOf", [])
    good = lambda k: sum((_valid(x).cast("int") for x in choices[k]), F.lit(0))
    if "anyOf" in choices:
        out.append(at.broken("anyOf", None, good("anyOf") > 0))
    if "oneOf" in choices:
        out.append(at.broken("oneOf", None, good("oneOf") == 1))
    if "not" in schema:
        out.append(at.broken("not", None, ~_valid(_joined(_rules(schema["not"], value, path, kind)))))
    if "if" in schema:
        holds = _valid(_joined(_rules(schema["if"], value, path, kind)))
        out.append(F.when(holds, _joined(_rules(schema.get("then", True), value, path, kind))).otherwise(_joined(_rules(schema.get("else", True), value, path, kind))))
    return out


def _joined(found: list[Column]) -> Column:
    return F.concat(*found) if found else F.array().cast(FOUND)


def compiled(schema: dict | str, value: Column) -> Column:
    """(path, rule) of each violation of a VARIANT value, by path and rule; null for a null value."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    found = F.array_sort(F.array_distinct(_checked(schema, value, F.lit("$"))))
    return F.when(value.isNotNull(), found)


def checked(rows: DataFrame, schema: dict | str, record: str = "record", found: str = "violations") -> DataFrame:
    """The rows with what is wrong with each record (a JSON text or a VARIANT). A text that is no JSON has the rule ``json``."""
    text = dict(rows.dtypes)[record] == "string"
    value = "__variant"
    rows = rows.withColumn(value, F.try_parse_json(record) if text else F.col(record))
    none = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))
    return rows.withColumn(found, F.coalesce(compiled(schema, F.col(value)), none)).drop(value)


def violations(rows: DataFrame, schema: dict | str, keys: list[str], record: str = "record") -> DataFrame:
    """keys, path, rule: a row for each violation."""
    return checked(rows, schema, record).select(*keys, F.inline("violations"))


def violation_counts(rows: DataFrame, schema: dict | str, record: str = "record") -> DataFrame:
    """path (places in lists as ``[]``), rule, n, records: how often each rule is broken, and by how many records."""
    plain = F.transform("violations", lambda v: F.struct(F.regexp_replace(v["path"], r"\[\d+\]", "[]").alias("path"), v["rule"].alias("rule")))
    each = checked(rows, schema, record).select(plain.alias("all"))
    each = each.select("all", F.posexplode("all").alias("at", "v"))
    first = F.array_position("all", F.col("v")) == F.col("at") + 1  # of the record's own
    return each.groupBy("v.path", "v.rule").agg(F.count("*").alias("n"), F.sum(first.cast("long")).alias("records"))


def split_valid(rows: DataFrame, schema: dict | str, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """The rows whose record is valid, and the others with what is wrong."""
    seen = checked(rows, schema, record)
    return seen.where(F.size("violations") == 0).drop("violations"), seen.where(F.size("violations") > 0)
