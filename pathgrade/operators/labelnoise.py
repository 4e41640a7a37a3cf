"""Label issues by confident learning: the confident joint, its calibration, and pruning by noise rate.

Rows have an item, the class that it is given (1 to ``classes``) and a probability for each class (p1, p2, ...); ``by``
names columns whose groups are looked at each by itself.

  * A class is confident for an item if its probability reaches the mean that items given it have for it (less a
    millionth). One confident class is the guess; of several it is the most probable class. Items without one have no
    guess. A class that no item is given is never confident.
  * The confident joint counts items by given class and guess (the diagonal is 1 at least). Calibrated, each row sums to
    its class's number of items, in whole numbers.
  * A cell (given k, truly j) says how many of the items given k are to be pruned: those with the largest margins
    p_j - p_k, ties included. Class k keeps one item at least.

The margin that a cell's depth comes to is found by counts in ranges of margins, and only within the range that holds it
by distinct margins; no window has a row for each item. The joint has a row for each group and pair of classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLOSE = 1e-6
#: Ranges of a unit of margin.
RANGES = 2048


def probabilities(labels: DataFrame, classes: int = 4, smoothing: float = 0.1, by: tuple[str, ...] = (), given: Column | None = None) -> DataFrame:
    """by, item, given, p1, ...: raters' votes as probabilities; most votes are the given class, the lowest of equals.
    ``given``: an aggregate of an item's votes that says the given class instead.

    Votes beyond the classes count as the nearest one; null votes do not count.
    """
    kinds = range(1, classes + 1)
    inside = F.greatest(F.lit(1), F.least(F.lit(classes), F.col("label")))
    votes = labels.where("label is not null").groupBy(*by, "item").agg(*[F.sum((inside == k).cast("int")).alias(f"v{k}") for k in kinds], (F.lit(None) if given is None else given).cast("int").alias("given"))
    n = reduce(lambda a, b: a + b, [F.col(f"v{k}") for k in kinds])
    counts = F.array(*[F.col(f"v{k}") for k in kinds])
    shares = [((F.col(f"v{k}") + smoothing) / (n + classes * smoothing)).alias(f"p{k}") for k in kinds]
    most = F.array_position(counts, F.array_max(counts)).cast("int") if given is None else F.col("given")
    return votes.select(*by, "item", most.alias("given"), *shares)


def _p(classes: int) -> Column:
    return F.array(*[F.col(f"p{k}") for k in range(1, classes + 1)])


def _beside(rows: DataFrame, small: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each row with its group's row of a table that has one for each group."""
    return rows.join(F.broadcast(small), list(by), "left") if by else rows.crossJoin(F.broadcast(small))


def with_guess(rows: DataFrame, classes: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds likely: the class that the item is confidently of; null without one."""
    kinds = range(1, classes + 1)
    mean = lambda k: F.avg(F.when(F.col("given") == k, F.col(f"p{k}")))
    means = rows.groupBy(*by).agg(*[F.when(mean(k).isNotNull(), F.greatest(mean(k), F.lit(2 * CLOSE))).alias(f"__t{k}") for k in kinds])
    rows = _beside(rows, means, by)
    sure = F.filter(F.array(*[F.when(F.col(f"p{k}") >= F.col(f"__t{k}") - CLOSE, F.lit(k)) for k in kinds]), lambda k: k.isNotNull())
    best = F.array_position(_p(classes), F.array_max(_p(classes))).cast("int")
    return rows.withColumn("likely", F.when(F.size(sure) > 1, best).otherwise(F.get(sure, F.lit(0)))).drop(*[f"__t{k}" for k in kinds])


def confident_joint(guessed: DataFrame, classes: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """by, given, likely, n: a row for each pair of classes."""
    found = guessed.groupBy(*by, "given", "likely").agg(F.count("*").alias("n"))
    groups = found.select(*by).distinct() if by else found.sparkSession.range(1).select()
    kinds = F.sequence(F.lit(1), F.lit(classes))
    grid = groups.select(*by, F.explode(kinds).alias("given")).select("*", F.explode(kinds).alias("likely"))
    out = grid.join(F.broadcast(found), [*by, "given", "likely"], "left")  # groups by classes by classes
    least = F.when(F.col("given") == F.col("likely"), 1).otherwise(0)
    return out.select(*by, "given", "likely", F.greatest(F.coalesce("n", F.lit(0)), least).cast("long").alias("n"))


def _whole(cells: DataFrame, value: str, row: list[str], column: str) -> DataFrame:
    """``value`` in whole numbers so that each row keeps its (rounded) sum: what is missing or too much after rounding is
    made good, one each, by the cells that lost most in it; of equals the last column first."""
    each = Window.partitionBy(*row)
    cells = cells.withColumn("__r", F.rint(value)).withColumn("__off", F.rint(F.sum(value).over(each)) - F.sum("__r").over(each))
    cells = cells.withColumn("__nth", F.row_number().over(each.orderBy(F.desc(F.col(value) - F.col("__r")), F.desc(column))))
    out = F.col("__r") + F.when(F.col("__nth") <= F.abs(F.col("__off")), F.signum("__off")).otherwise(0.0)
    return cells.withColumn(value, out).drop("__r", "__off", "__nth")


def calibrated(joint: DataFrame, sizes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, given, likely, n: each row scaled to its class's number of items (``sizes``: by, given, size), in whole numbers."""
    rows = joint.join(F.broadcast(sizes), [*by, "given"], "left").withColumn("size", F.coalesce("size", F.lit(0)))  # groups by classes
    rows = rows.withColumn("x", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "given")) * F.col("size"))
    return _whole(rows, "x", [*by, "given"], "likely").select(*by, "given", "likely", F.col("x").cast("long").alias("n"))


def to_prune(joint: DataFrame, keep: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, given, likely, n: how many of each cell go. A class's diagonal is ``keep`` at least, at the expense of its other cells."""
    row = Window.partitionBy(*by, "given")
    diagonal = F.col("given") == F.col("likely")
    rows = joint.withColumn("n", F.col("n").cast("double"))
    short = F.max(F.when(diagonal, F.greatest(keep - F.col("n"), F.lit(0.0)))).over(row)
    others = F.greatest(F.sum((F.col("n") != 0).cast("int")).over(row) - 1, F.lit(1))
    rows = rows.withColumn("x", F.when(diagonal, F.greatest(F.col("n"), F.lit(float(keep)))).otherwise(F.greatest(F.col("n") - short / others, F.lit(0.0))))
    return _whole(rows, "x", [*by, "likely"], "given").where(~diagonal & (F.col("x") > 0)).select(*by, "given", "likely", F.col("x").cast("long").alias("n"))


def margins(rows: DataFrame, prune: DataFrame, classes: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """by, given, likely, margin: the nth largest margin of each cell to prune (the smallest if it has fewer items)."""
    cell = [*by, "given", "likely"]
    apart = F.element_at(_p(classes), F.col("likely")) - F.element_at(_p(classes), F.col("given"))
    long = rows.join(F.broadcast(prune), [*by, "given"]).select(*cell, "n", apart.alias("margin"))  # groups by classes by classes
    long = long.withColumn("range", F.floor(F.col("margin") * RANGES))
    sums = long.groupBy(*cell, "n", "range").agg(F.count("*").alias("c"), F.min("margin").alias("least"))
    sums = sums.withColumn("above", F.sum("c").over(Window.partitionBy(*cell).orderBy(F.desc("range"))) - F.col("c"))
    hit = sums.where((F.col("above") < F.col("n")) & (F.col("above") + F.col("c") >= F.col("n"))).select(*cell, "range", (F.col("n") - F.col("above")).alias("left"))
    within = long.join(F.broadcast(hit), [*cell, "range"]).groupBy(*cell, "left", "margin").agg(F.count("*").alias("c"))
    within = within.withColumn("upto", F.sum("c").over(Window.partitionBy(*cell).orderBy(F.desc("margin"))))
    found = within.where("upto >= left").groupBy(*cell).agg(F.max("margin").alias("margin"))
    every = sums.groupBy(*cell).agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.min("least").alias("margin")).where("c < n")
    return found.unionByName(every.select(*cell, "margin"))


def noise_rate_issues(rows: DataFrame, classes: int = 4, keep: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, item, given, likely, pruned (by a cell of the calibrated joint), issue (pruned, and the given class is not the
    most probable one).

    ``rows``: by, item, given, p1 to p``classes``. A class of ``keep`` items or fewer is left alone. Rows are read for
    the means, the joint, the margins and the marks; write them first if they are costly.
    """
    guessed = with_guess(rows, classes, by)
    sizes = rows.groupBy(*by, "given").agg(F.count("*").alias("size"))
    prune = to_prune(calibrated(confident_joint(guessed, classes, by), sizes, by), keep, by)
    prune = prune.join(F.broadcast(sizes.where(F.col("size") > keep).drop("size")), [*by, "given"])  # groups by classes
    cuts = margins(rows, prune, classes, by).groupBy(*by, "given").agg(F.collect_list(F.struct("likely", "margin")).alias("__cuts"))
    out = guessed.join(F.broadcast(cuts), [*by, "given"], "left")  # groups by classes
    p = _p(classes)
    own = F.element_at(p, F.col("given"))
    over = F.exists("__cuts", lambda c: F.element_at(p, c["likely"]) - own >= c["margin"])
    out = out.withColumn("pruned", F.coalesce(over, F.lit(False)))
    stays = own + CLOSE >= F.array_max(p)
    return out.select(*by, "item", "given", "likely", "pruned", (F.col("pruned") & ~stays).alias("issue"))
