"""Raters that do not fit: suspicion, injected raters, how well they are found, and the quality of labels."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K

EPSILON = 1e-9
#: Ranges of a unit of score within which ranks are counted.
SCORE_RANGES = 4096


def suspicion(labels: DataFrame) -> DataFrame:
    """rater, deviation (mean distance from the panel's mean, which includes the rater), suspicion (scaled to 0 to 1)."""
    panel = F.avg("label").over(Window.partitionBy("item", "dim"))
    dev = labels.withColumn("off", F.abs(F.col("label") - panel)).groupBy("rater").agg(F.avg("off").alias("deviation"))
    every = Window.partitionBy(F.lit(0))  # a row for each rater
    low, high = F.min("deviation").over(every), F.max("deviation").over(every)
    return dev.select("rater", "deviation", F.when(high - low < EPSILON, 0.0).otherwise((F.col("deviation") - low) / (high - low)).alias("suspicion"))


def inject(labels: DataFrame, names: list[str], dims: tuple[str, ...] = K.DIMENSIONS) -> DataFrame:
    """The rows and those of injected raters, for each item in each of ``dims``: step quality one above the panel's rounded
    mean, privacy one below, others at it. Where an item has no label in a dimension the mean is 2.5."""
    means = labels.groupBy("item").agg(*[F.avg(F.when(F.col("dim") == d, F.col("label"))).alias(d) for d in dims])
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(d, F.lit(2.5)).alias("m")) for d in dims])
    mean = means.select("item", F.inline(cells))
    r = F.bround("m").cast("int")
    label = F.when(F.col("dim") == "step_quality", F.least(F.lit(4), r + 1)).when(F.col("dim") == "privacy_compliance", F.greatest(F.lit(1), r - 1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), r)))
    fake = mean.select("item", "dim", label.alias("label"), F.explode(F.array(*[F.lit(n) for n in names])).alias("rater"), F.lit(True).alias("injected"))
    return labels.unionByName(fake, allowMissingColumns=True)


def detection(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two tables of names."""
    both = found.select("rater").distinct().withColumn("f", F.lit(1)).join(truth.select("rater").distinct().withColumn("t", F.lit(1)), "rater", "full")
    c = both.agg(F.sum(F.expr("int(f is not null and t is not null)")).alias("tp"), F.sum(F.expr("int(t is null)")).alias("fp"), F.sum(F.expr("int(f is null)")).alias("fn")).fillna(0)
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON), F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON))


def auc(scores: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve by ranks; counts by distinct score, so ties count half.

    Ranks are sums over ranges of scores, and within a range over its scores: no window has all of them.
    """
    c = scores.groupBy(F.round(score, 9).alias("s")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) == 0).cast("long")).alias("n"))
    c = c.withColumn("range", F.floor(F.col("s") * SCORE_RANGES))
    ranges = c.groupBy("range").agg(F.sum("n").alias("rn"))
    earlier = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", earlier("rn", Window.partitionBy(F.lit(0)).orderBy("range")).alias("before"))
    c = c.join(ranges, "range").withColumn("below", F.col("before") + earlier("n", Window.partitionBy("range").orderBy("s")))
    return c.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def roc(scores: DataFrame, score: str, truth: str, points: int = 100) -> DataFrame:
    """threshold, tpr, fpr at thresholds 0 to 1 in equal steps: counts by step, then sums over the steps."""
    step = F.least(F.lit(points), F.greatest(F.lit(0), F.floor(F.round(F.col(score) * points, 9)))).cast("int")
    c = scores.groupBy(step.alias("k")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) == 0).cast("long")).alias("n"))
    grid = scores.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("k"))
    c = grid.join(F.broadcast(c), "k", "left").fillna(0, ["p", "n"])  # a row for each step
    above, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")), Window.partitionBy(F.lit(0))
    rate = lambda x: F.sum(x).over(above) / F.nullif(F.sum(x).over(every), F.lit(0))
    return c.select((F.col("k") / points).alias("threshold"), rate("p").alias("tpr"), rate("n").alias("fpr"))


def sweep(scores: DataFrame, score: str, truth: str, points: int = 500, top: float = 1.01) -> DataFrame:
    """threshold, tpr, fpr: who scores at least the threshold, at ``points`` equal steps from 0 to ``top``. Without a positive (negative) the rate is 0.

    Scores are counted by the last step that they reach, so only steps are summed over.
    """
    step = top / (points - 1)
    near = F.floor(F.col(score) / step)
    k = F.when((near + 1) * step <= F.col(score), near + 1).when(near * step > F.col(score), near - 1).otherwise(near)
    known = scores.where(F.col(score).isNotNull()).groupBy(F.least(F.lit(points - 1), k).cast("int").alias("k"))
    counts = known.agg(F.sum((F.col(truth) == 1).cast("long")).alias("p"), F.sum((F.col(truth) == 0).cast("long")).alias("n"))
    every = scores.agg(F.sum((F.col(truth) == 1).cast("long")).alias("all_p"), F.sum((F.col(truth) == 0).cast("long")).alias("all_n"))
    grid = scores.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    rows = grid.join(F.broadcast(counts), "k", "left").fillna(0, ["p", "n"]).crossJoin(F.broadcast(every))  # a row for each step; one row
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    rate = lambda x: F.coalesce(F.sum(x).over(above) / F.nullif(F.col(f"all_{x}"), F.lit(0)), F.lit(0.0))
    return rows.select((F.col("k") * step).alias("threshold"), rate("p").alias("tpr"), rate("n").alias("fpr"))


def trapezoid(curve: DataFrame) -> DataFrame:
    """auc: the area under (fpr, tpr) from the highest threshold down."""
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("threshold"))
    rows = curve.select("tpr", "fpr", F.lag("tpr").over(down).alias("t"), F.lag("fpr").over(down).alias("f"))
    return rows.agg(F.coalesce(F.sum((F.col("fpr") - F.col("f")) * (F.col("tpr") + F.col("t")) / 2), F.lit(0.0)).alias("auc"))


def label_confidence(labels: DataFrame, classes: int = 4, smoothing: float = 0.1) -> DataFrame:
    """item, given (most votes, the lowest of equals), confidence (its smoothed share)."""
    votes = labels.where("label is not null").groupBy("item", F.greatest(F.lit(1), F.least(F.lit(classes), F.col("label"))).alias("label")).agg(F.count("*").alias("v"))
    best = votes.groupBy("item").agg(F.max(F.struct("v", (-F.col("label")).alias("l"))).alias("b"), F.sum("v").alias("n"))
    return best.select("item", (-F.col("b.l")).alias("given"), ((F.col("b.v") + smoothing) / (F.col("n") + classes * smoothing)).alias("confidence"))
