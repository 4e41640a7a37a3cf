"""Calibration of raters: where they differ, anchors to show them, gold scores, pulled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K


def hotspots(labels: DataFrame, kappas: DataFrame, top: int = 3, items: int = 3) -> DataFrame:
    """The dimensions with the lowest agreement, and in each the items whose scores vary most.

    dim, kappa, rank, item, variance, item_rank. The window ranks within a dimension; only its first rows are kept.
    """
    ranked = kappas.withColumn("rank", F.row_number().over(Window.orderBy(F.round("kappa", 9), "dim"))).where(F.col("rank") <= top)
    spread = labels.groupBy("dim", "item").agg(F.var_samp("label").alias("variance"))
    spread = spread.join(F.broadcast(ranked), "dim")  # ``top`` rows
    own = Window.partitionBy("dim").orderBy(F.round("variance", 9).desc(), "item")
    return spread.withColumn("item_rank", F.row_number().over(own)).where(F.col("item_rank") <= items)


def rules_for(kappas: DataFrame, rules: DataFrame, top: int = 3) -> DataFrame:
    """dim, rank, rule: the rubric's rules for the dimensions with the lowest agreement; dimensions without a rule drop out."""
    ranked = kappas.withColumn("rank", F.row_number().over(Window.orderBy(F.round("kappa", 9), "dim"))).where(F.col("rank") <= top)  # a row for each dimension
    return ranked.join(F.broadcast(rules), "dim").select("dim", "rank", "rule")  # a rubric's few rules


def normalised(labels: DataFrame, all_of: int) -> DataFrame:
    """item, score: the mean of (label - 1) / 3 for items that have all their labels."""
    return labels.where("label is not null").groupBy("item").agg(F.count("*").alias("n"), F.avg((F.col("label") - 1) / 3).alias("score")).where(F.col("n") == all_of).select("item", "score")


def gold(labels: DataFrame) -> DataFrame:
    """item, dim, gold: the median, rounded half to even."""
    return labels.groupBy("item", "dim").agg(F.bround(F.percentile("label", F.lit(0.5))).cast("int").alias("gold"))


def anchors(scores: DataFrame) -> DataFrame:
    """Two good, two bad and one middling item, none twice; a tier that is short is filled by rank.

    Each tier takes a few rows by a top-n, and the next leaves them out.
    """
    s = F.round(F.col("score"), 9)

    def take(rows: DataFrame, inside: Column, order: list[Column], fill: list[Column], n: int, tier: str, at: int) -> DataFrame:
        best = rows.orderBy(F.when(inside, 0).otherwise(1), *[F.when(inside, o) for o in order], *fill, "item").limit(n)
        return best.withColumn("tier", F.lit(tier)).withColumn("tier_no", F.lit(at))

    good = take(scores, s > K.ANCHOR_GOOD, [-s], [-s], 2, "clearly_good", 1)
    rest = scores.join(F.broadcast(good.select("item")), "item", "left_anti")
    bad = take(rest, s < K.ANCHOR_BAD, [s], [s], 2, "clearly_bad", 3)
    rest = rest.join(F.broadcast(bad.select("item")), "item", "left_anti")
    middle = take(rest, s.between(*K.ANCHOR_MIDDLE), [F.abs(s - 0.5)], [F.abs(s - 0.5)], 1, "borderline", 2)
    return good.unionByName(middle).unionByName(bad)


def calibrated(base: Column, target: Column, weight: float = K.CALIBRATION_WEIGHT) -> Column:
    """A score pulled towards its gold target."""
    return F.greatest(F.lit(1), F.least(F.lit(4), F.bround(weight * target + (1 - weight) * base).cast("int")))


def mean_gold(gold_rows: DataFrame) -> DataFrame:
    return gold_rows.groupBy("dim").agg(F.coalesce(F.avg("gold"), F.lit(2.5)).alias("mean_gold"))


def pulled(labels: DataFrame, anchor_gold: DataFrame) -> DataFrame:
    """item, dim, rater, calibrated: scores pulled to the anchor's gold, or to the dimension's mean over the anchors, rounded half to even."""
    mean = mean_gold(anchor_gold).select("dim", F.bround("mean_gold").alias("mean_gold"))
    rows = labels.join(F.broadcast(anchor_gold), ["item", "dim"], "left").join(F.broadcast(mean), "dim", "left")  # a few anchors by dimension
    return rows.select("item", "dim", "rater", calibrated(F.col("label"), F.coalesce("gold", "mean_gold", F.lit(2))).alias("calibrated"))


def target_gate(alphas: DataFrame, target: float = K.ALPHA_TARGET) -> DataFrame:
    """Whether every dimension and the mean reach the target."""
    return alphas.agg(F.min("alpha").alias("lowest"), F.avg("alpha").alias("mean_alpha"), (F.bool_and(F.round("alpha", 9) >= target) & (F.round(F.avg("alpha"), 9) >= target)).alias("passes"))


def disagreement(ratings: DataFrame, group: str = "topic") -> DataFrame:
    """Mean over samples of the raters' deviation, by group and dimension."""
    per = ratings.groupBy(group, "dim", "item").agg(F.stddev_samp("label").alias("sd"))
    return per.groupBy(group, "dim").agg(F.coalesce(F.avg("sd"), F.lit(0.0)).alias("disagreement"))


def disagreement_grid(ratings: DataFrame, dims: list[str], group: str = "topic") -> DataFrame:
    """A row for each group and a column for each dimension; a cell that no rating fills is 0."""
    return disagreement(ratings, group).groupBy(group).pivot("dim", dims).agg(F.first("disagreement")).fillna(0.0, dims)
