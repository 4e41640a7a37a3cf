"""The given tables as trajectories, annotations, logs, runs and roles: in Spark, and the same as SQL.

A trajectory is what one user does in one day; its steps are the events in order. Labels of raters and what tables do
not hold are functions of SHA-256 of the row's key, so that any engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K

OTHER = "unknown_context"
SCENARIO_OF = (*K.SCENARIOS, OTHER)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(*parts: Column | str) -> Column:
    """The first 32 bits of SHA-256 of the parts joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def number_sql(*parts: str) -> str:
    return f"('0x' || substr(sha256({" || ':' || ".join(parts)}), 1, 8))::BIGINT"


def pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def pick_sql(names: tuple[str, ...], index: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], ({index})::INTEGER + 1)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    own = Window.partitionBy("user_id", "day")
    e = e.withColumn("day", day)
    return e.select(
        F.concat_ws(":", "user_id", "day").alias("traj"),
        "user_id",
        "day",
        (F.row_number().over(own.orderBy("ts", "event_id")) - 1).alias("step_index"),
        F.count("*").over(own).alias("n_steps"),
        F.when(F.col("value") > 200, "mystery_tool")
        .when(F.col("event_type").isin("view", "signup"), "")
        .when(F.col("event_type") == "click", "log_and_monitor")
        .when(F.col("event_type") == "purchase", "send_alert")
        .otherwise(K.ESCALATION)
        .alias("action"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("confidence"),
        pick(SCENARIO_OF, F.col("user_id") % 6).alias("scenario"),
        pick(K.CONSENTS, F.col("user_id") % 4).alias("consent"),
        "value",
        "event_type",
        "event_id",
        F.col("props").alias("observation"),
    )


STEPS = f"""f_steps AS (
  SELECT traj, user_id, day, step_index, n_steps,
         CASE WHEN value > 200 THEN 'mystery_tool' WHEN event_type IN ('view', 'signup') THEN ''
              WHEN event_type = 'click' THEN 'log_and_monitor' WHEN event_type = 'purchase' THEN 'send_alert'
              ELSE 'escalate_to_emergency' END AS action,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100e0 AS confidence,
         {pick_sql(SCENARIO_OF, "user_id % 6")} AS scenario, {pick_sql(K.CONSENTS, "user_id % 4")} AS consent,
         value, event_type, event_id, props AS observation
  FROM (SELECT *, CAST(ts AS DATE) AS day, user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS traj,
               row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS step_index,
               count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n_steps
        FROM events))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each trajectory: what a device saw in it."""
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    t = e.withColumn("traj", F.concat_ws(":", "user_id", "day"))
    words = ("help", "therapy", "meeting", "dizzy", "secret", "music", "weather", "lunch")
    return t.select(
        "traj",
        "user_id",
        "day",
        pick(SCENARIO_OF, F.col("user_id") % 6).alias("scenario"),
        pick(K.CONSENTS, F.col("user_id") % 4).alias("consent"),
        (60 + number(F.col("traj"), "hr") % 120).cast("double").alias("heart_rate"),
        (84 + number(F.col("traj"), "spo2") % 16).cast("double").alias("spo2"),
        (50 + number(F.col("traj"), "db") % 50).cast("double").alias("noise_db"),
        F.array(pick(words, number(F.col("traj"), "w1") % 8), pick(words, number(F.col("traj"), "w2") % 8)).alias("keywords"),
        pick(K.ACTIONS, number(F.col("traj"), "gt") % 8).alias("ground_truth"),
    )


_WORDS = ("help", "therapy", "meeting", "dizzy", "secret", "music", "weather", "lunch")
ITEMS = f"""f_items AS (
  SELECT traj, user_id, day, {pick_sql(SCENARIO_OF, "user_id % 6")} AS scenario, {pick_sql(K.CONSENTS, "user_id % 4")} AS consent,
         (60 + {number_sql("traj", "'hr'")} % 120)::DOUBLE AS heart_rate, (84 + {number_sql("traj", "'spo2'")} % 16)::DOUBLE AS spo2,
         (50 + {number_sql("traj", "'db'")} % 50)::DOUBLE AS noise_db,
         [{pick_sql(_WORDS, number_sql("traj", "'w1'") + " % 8")}, {pick_sql(_WORDS, number_sql("traj", "'w2'") + " % 8")}] AS keywords,
         {pick_sql(K.ACTIONS, number_sql("traj", "'gt'") + " % 8")} AS ground_truth
  FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS traj FROM events))"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, rater, dim, score (1 to 4), missing: five raters, four dimensions, in long form."""
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    # a fixed number of parts: a day is few bytes but twenty rows with digests, so parts are not to be merged by bytes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    e = e.repartition(parts, "user_id", "day").distinct()
    t = F.col("traj")
    rows = e.select(F.concat_ws(":", "user_id", "day").alias("traj"))
    # what depends on the rater or the dimension alone is computed once for it, before the rows of the other
    missed = [F.struct(F.lit(r).alias("rater"), (number(t, F.lit(r), "miss") % 20 == 0).alias("missing")) for r in K.RATERS]
    based = [F.struct(F.lit(x).alias("dim"), (1 + number(t, F.lit(x)) % 4).alias("base")) for x in K.DIMENSIONS]
    rows = rows.select("traj", F.array(*missed).alias("missed"), F.inline(F.array(*based))).select("traj", "dim", "base", F.inline("missed"))
    noise = number(t, F.col("rater"), F.col("dim")) % 5
    score = F.col("base") + (noise == 4).cast("int") - (noise == 0).cast("int")
    return rows.select("traj", "rater", "dim", F.greatest(F.lit(1), F.least(F.lit(4), score)).cast("int").alias("score"), "missing")


ANNOTATIONS = f"""f_ann AS (
  SELECT traj, rater, dim,
         greatest(1, least(4, 1 + {number_sql("traj", "dim")} % 4
           + CASE {number_sql("traj", "rater", "dim")} % 5 WHEN 0 THEN -1 WHEN 4 THEN 1 ELSE 0 END))::INTEGER AS score,
         {number_sql("traj", "rater", "'miss'")} % 20 = 0 AS missing
  FROM (SELECT DISTINCT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS traj FROM events),
       (SELECT unnest([{', '.join(repr(r) for r in K.RATERS)}]) AS rater), (SELECT unnest([{', '.join(repr(d) for d in K.DIMENSIONS)}]) AS dim))"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as role annotations: conv_id, pos, agent_role, delegation_quality, authority_appropriate, accountability_clear, handoff_quality."""
    c = read(spark, sf_dir, "conversations")
    n = F.length("text")
    role = F.when(F.col("role") == "assistant", "orchestrator").when(F.col("role") == "user", "health_agent").otherwise("privacy_gate_agent")
    return c.select(
        "conv_id",
        F.col("turn").alias("pos"),
        role.alias("agent_role"),
        (1 + n % 5).alias("delegation_quality"),
        (n % 7 != 0).alias("authority_appropriate"),
        (n % 11 == 0).alias("accountability_clear"),
        F.when(role == "orchestrator", 1 + n % 3).alias("handoff_quality"),
        (F.col("conv_id") % 3 == 0).alias("goal_achieved"),
    )


ROLES = """f_roles AS (
  SELECT conv_id, turn AS pos,
         CASE role WHEN 'assistant' THEN 'orchestrator' WHEN 'user' THEN 'health_agent' ELSE 'privacy_gate_agent' END AS agent_role,
         1 + length(text) % 5 AS delegation_quality, length(text) % 7 <> 0 AS authority_appropriate,
         length(text) % 11 = 0 AS accountability_clear, CASE WHEN role = 'assistant' THEN 1 + length(text) % 3 END AS handoff_quality,
         conv_id % 3 = 0 AS goal_achieved
  FROM conversations)"""
