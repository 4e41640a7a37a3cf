"""Logs that fail are put apart with the reason, and no neighbour is lost: raw records to scores, or to errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import metrics, schema_rules, trajectory

#: What a log must have to be scored. The names of its fields.
STEP = {
    "type": "object",
    "required": ["action"],
    "properties": {
        "step_index": {"type": ["integer", "null"]},
        "action": {"type": ["string", "null"]},
        "observation": {"type": ["string", "null"]},
        "confidence": {"type": ["number", "null"], "minimum": 0, "maximum": 1},
    },
}
LOG = {
    "type": "object",
    "required": ["scenario_type", "trajectory"],
    "properties": {
        "scenario_type": {"type": "string", "enum": list(K.SCENARIOS)},
        "consent_model": {"type": ["string", "null"]},
        "ground_truth_action": {"type": ["string", "null"]},
        "trajectory": {"type": "array", "minItems": 1, "items": STEP},
    },
}
_STEPS = "array<struct<step_index:int,action:string,observation:string,confidence:double>>"


def examined(logs: DataFrame, key: str = "log_id", record: str = "record", schema: dict | None = None) -> DataFrame:
    """key, log (VARIANT), error: a struct of stage (parse, schema), path, rule and how many; null for a sound log."""
    rows = schema_rules.checked(logs.withColumn("__text", F.col(record)), schema or LOG, "__text", "__found")
    first = F.get("__found", F.lit(0))
    stage = F.when(first["rule"] == "json", "parse").otherwise("schema")
    error = F.when(F.size("__found") > 0, F.struct(stage.alias("stage"), first["path"].alias("path"), first["rule"].alias("rule"), F.size("__found").alias("n")))
    # a generator: what reads only parts of the error, or filters by it, does not check the record again
    return rows.select(F.col(key).alias("log_id"), F.try_parse_json("__text").alias("log"), F.explode_outer(F.array(error)).alias("error"))


def step_facts(logs: DataFrame) -> DataFrame:
    """The rows with what a sound log's steps come to, within its row: no shuffle, no copies of steps. Null for others."""
    get = lambda name, kind="string": F.try_variant_get("log", f"$.{name}", kind)
    step = lambda s: F.struct(F.coalesce(s["action"], F.lit("")).alias("action"), s["observation"].alias("observation"))
    steps = F.when(F.col("error").isNull(), F.transform(get("trajectory", _STEPS), step))
    # generators: the steps are taken from the log once, not for each fact
    rows = logs.select("*", get("scenario_type").alias("scenario"), get("ground_truth_action").alias("truth"), F.explode_outer(F.array(steps)).alias("steps"))
    rows = rows.withColumn("steps", F.when(F.size("steps") > 0, F.col("steps"))).withColumn("n", F.when(F.col("steps").isNotNull(), F.size("steps")))
    last = lambda i: i == F.col("n") - 1
    final = F.element_at("steps", -1)["action"]
    places = F.transform("steps", lambda s, i: F.when((s["action"] == K.ESCALATION) & ~last(i), i))
    expected = F.transform("steps", lambda s, i: F.when(s["action"] != "", F.when(last(i), s["action"] == F.col("truth")).otherwise(F.lit(False))))
    told = F.filter(expected, lambda x: x.isNotNull())
    hits = F.size(F.filter(told, lambda x: x))
    return rows.withColumns(
        {
            "final_action": final,
            "valid": F.size(F.filter("steps", lambda s: (s["action"] == "") | s["action"].isin(*K.ACTIONS))),
            "escalated": F.array_min(places),
            "mean_confidence": F.lit(None).cast("double"),
            "success": final.isin(*K.TERMINAL_ACTIONS).cast("double") / F.col("n"),
            "tool": F.when(F.col("n").isNotNull(), F.when(F.size(told) == 0, 1.0).otherwise(hits / F.size(told))),
            "leak": F.exists("steps", lambda s: T.has_pii(s["observation"])),
        }
    )


def scores(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics and layers of each row of step_facts, their total and the overall score, offline."""
    rows = trajectory.layered(facts, [*keys, "success", "tool", "leak"]).withColumn("total", trajectory.total())
    rows = rows.withColumns({"grounded": F.lit(K.GROUNDED_OFFLINE), "role": F.lit(1.0), "latency": F.lit(1.0)})
    rows = rows.withColumn("overall", metrics.overall(F.col("leak")))
    return rows.select(*keys, *[F.when(F.col("n").isNotNull(), F.col(c)).alias(c) for c in SCORES])


SCORES = ["n", "success", "tool", "leak", "intent", "planning", "tool_calls", "recovery", "outcome", "total", "overall"]


def evaluated(logs: DataFrame, key: str = "log_id", record: str = "record") -> DataFrame:
    """log_id, SCORES, error: a row for each log; a log that cannot be scored has an error and null scores.

    Rows that repeat an id or a content are logs of their own. A log is scored within its row.
    """
    return scores(step_facts(examined(logs, key, record)), ["log_id", "error"]).select("log_id", *SCORES, "error")


def scored_one(spark, record: str) -> dict:
    """The scores of a single log, or its error."""
    return evaluated(spark.createDataFrame([("", record)], "log_id string, record string")).drop("log_id").first().asDict(recursive=True)


def write_apart(rows: DataFrame, good: str, bad: str) -> None:
    """Rows without an error as Parquet in one folder, the others in another."""
    rows.where("error is null").drop("error").write.mode("overwrite").parquet(good)
    rows.where("error is not null").select("log_id", "error.*").write.mode("overwrite").parquet(bad)


def error_counts(rows: DataFrame) -> DataFrame:
    """stage, path, rule, n of the rows that failed; places in lists count together."""
    plain = F.regexp_replace("error.path", r"\[\d+\]", "[]")
    return rows.where("error is not null").groupBy(F.col("error.stage").alias("stage"), plain.alias("path"), F.col("error.rule").alias("rule")).agg(F.count("*").alias("n"))
