"""Putting datasets together: phases, trajectory facts, first rows, exact and near copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_phases(pre: DataFrame, post: DataFrame) -> DataFrame:
    return pre.withColumn("calibration_phase", F.lit("pre")).unionByName(post.withColumn("calibration_phase", F.lit("post")), allowMissingColumns=True)


def phases_beside(rows: DataFrame, column: str, **phases: Column) -> DataFrame:
    """The rows once for each phase, with the phase's value of a column: union_phases of phases that are seen in the same rows, in one pass."""
    each = F.array(*[F.struct(F.lit(name).alias("calibration_phase"), value.alias(column)) for name, value in phases.items()])
    return rows.select("*", F.inline(each))


def trajectory_facts(steps: DataFrame, keys: list[str]) -> DataFrame:
    return steps.groupBy(*keys).agg(F.count("*").alias("n_trajectory_steps"), F.max_by("action", "step_index").alias("final_action"), F.avg("confidence").alias("mean_step_confidence"))


def assemble(rows: DataFrame, facts: DataFrame, on: list[str], order: list[str], tiny: list[str]) -> DataFrame:
    """Rows with their trajectory's facts, the known columns in order, scores as bytes. Rows without facts stay."""
    out = rows.join(facts, on, "left")
    for c in tiny:
        out = out.withColumn(c, F.col(c).cast("tinyint"))
    return out.select(*[c for c in order if c in out.columns])


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A top-1 window: what a task keeps before the shuffle is one row for each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text digest -> first id and number of rows; only the digest is shuffled."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))


def is_complete(filled: list[str], ranges: dict[str, tuple[float, float]]) -> Column:
    """Whether a record has all of these texts and all of these numbers within their ranges."""
    parts = [F.col(c).isNotNull() & (F.length(c) > 0) for c in filled] + [F.col(c).between(a, b) for c, (a, b) in ranges.items()]
    return reduce(lambda x, y: x & y, (F.coalesce(p, F.lit(False)) for p in parts))


def orphans(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows that refer to nothing."""
    return rows.join(known, on, "left_anti")


def in_order(rows: DataFrame, key: str, n: int) -> DataFrame:
    """A scan with a limit, in the order of a key."""
    return rows.orderBy(key).limit(n)


def first_n_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; raises if a group has fewer."""
    own = Window.partitionBy(group).orderBy(order)
    out = rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= n)
    short = [r[group] for r in out.groupBy(group).count().where(F.col("count") < n).limit(20).collect()]
    if short:
        raise ValueError(f"fewer than {n} rows in {short}")
    return out.drop("__n")
