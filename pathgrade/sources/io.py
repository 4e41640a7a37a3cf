"""Scans and sinks: JSON lines, documents of JSON, CSV, Parquet; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "step_index INT, step_name STRING, observation STRING, reasoning STRING, action STRING, confidence DOUBLE"
LOG = (
    "log_id STRING, timestamp STRING, scenario_type STRING, consent_model STRING, "
    "sensor_data STRUCT<heart_rate: DOUBLE, spo2: DOUBLE, steps: DOUBLE, gps_lat: DOUBLE, gps_lon: DOUBLE, noise_db: DOUBLE, skin_temp_c: DOUBLE, "
    "heart_rate_noised: DOUBLE, spo2_noised: DOUBLE, steps_noised: DOUBLE, noise_db_noised: DOUBLE, gps_lat_noised: DOUBLE, gps_lon_noised: DOUBLE>, "
    "audio_transcript STRUCT<text: STRING, language: STRING, confidence: DOUBLE, duration_s: DOUBLE, keywords_detected: ARRAY<STRING>>, "
    "context_metadata MAP<STRING, STRING>, trajectory ARRAY<STRUCT<" + STEP.replace(" INT", ": INT").replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE") + ">>, ground_truth_action STRING"
)
ANNOTATION = (
    "annotation_id STRING, log_id STRING, persona_name STRING, scenario_type STRING, consent_model STRING, ground_truth_action STRING, "
    "step_quality INT, privacy_compliance INT, goal_alignment INT, error_recovery INT, rationale STRING, created_at STRING"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files of JSON, each an object or a list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_files(spark: SparkSession, path: str, schema: str, expected: int) -> DataFrame:
    """One document from each file of a pattern; another number of files is an error."""
    rows = read_documents(spark, path, schema)
    if len(found := rows.inputFiles()) != expected:  # a listing, nothing is read
        raise ValueError(f"{expected} files expected, {len(found)} found at {path}")
    return rows


def entries(documents: DataFrame, field: str) -> DataFrame:
    """A row for each entry of a document's list."""
    return documents.select(F.inline(field))


def discover(spark: SparkSession, folder: str, schema: str, marker: str, below_only: bool = False) -> DataFrame:
    """Records that have the marker column, wherever they lie below a folder, the file they are from, and their place.

    JSON lines are read line by line; documents are a list of records or an object with ``records``. ``place`` orders
    all records: by the parts of the file's path, then as they stand in it, however the files are cut for reading.
    ``below_only``: files of the folder itself do not count.
    """
    meta = "_metadata.file_path", "_metadata.file_block_start"

    def below(pattern: str, kind: str, **options) -> DataFrame:
        rows = spark.read.schema(kind).options(recursiveFileLookup=True, pathGlobFilter=pattern, **options).json(folder)
        # within a block of a file the rows' numbers rise as the lines do
        return rows.select("*", F.col(meta[0]).alias("file"), F.col(meta[1]).alias("block")).withColumn("row", F.monotonically_increasing_id())

    names = spark.createDataFrame([], schema).columns
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema.fields)
    lines = below("*.jsonl", schema).withColumn("nth", F.lit(0))
    whole = below("*.json", f"{schema}, records ARRAY<STRUCT<{fields}>>", multiLine=True)
    inside = whole.where("records is not null").select("file", "block", "row", F.posexplode("records").alias("nth", "r")).select(*[F.col("r")[n].alias(n) for n in names], "file", "block", "row", "nth")
    rows = lines.unionByName(whole.where("records is null").drop("records").withColumn("nth", F.lit(0))).unionByName(inside)
    if below_only:
        root = F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/"))
        rows = rows.where(F.regexp_replace(F.regexp_replace("file", "^[a-z0-9]+:/*/", "/"), "/[^/]*$", "") != root)
    place = F.struct(F.split("file", "/").alias("path"), "block", "row", "nth")
    return rows.where(F.col(marker).isNotNull()).select(*names, "file", place.alias("place"))


def first_seen(found: DataFrame, key: str, place: str = "place") -> DataFrame:
    """Of the records of each key the one that comes first; records whose key is null or empty do not count.

    An aggregate, not a window: what a task has read is one record for each key before it is shuffled.
    """
    rows = found.where(F.col(key).isNotNull() & (F.length(key) > 0))
    more = [c for c in rows.columns if c != place]
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*more), place).alias("__first")).select("__first.*")


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def steps_of(logs: DataFrame) -> DataFrame:
    """A row for each step of each log, as the operators expect them."""
    long = logs.select("log_id", F.col("scenario_type").alias("scenario"), F.col("consent_model").alias("consent"), F.size("trajectory").alias("n_steps"), F.posexplode("trajectory").alias("step_index", "s"))
    return long.select(F.col("log_id").alias("traj"), "scenario", "consent", "n_steps", "step_index", F.coalesce("s.action", F.lit("")).alias("action"), F.col("s.confidence").alias("confidence"))


def labels_of(annotations: DataFrame) -> DataFrame:
    """Annotation records in long form: item, rater, dim, label."""
    names = ["step_quality", "privacy_compliance", "goal_alignment", "error_recovery"]
    return annotations.select(F.col("log_id").alias("item"), F.col("persona_name").alias("rater"), *names).unpivot(["item", "rater"], names, "dim", "label")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_report(rows: DataFrame, path: str, name: str) -> None:
    """A summary as one document: the number of its rows and the rows. For reports, whose rows are few."""
    one = rows.agg(F.count("*").alias("n"), F.collect_list(F.struct(*rows.columns)).alias(name))
    one.coalesce(1).write.mode("overwrite").json(path)
