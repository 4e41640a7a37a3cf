"""Agreement of raters on long rows (group columns, item, rater, label): Cohen, Fleiss, Krippendorff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BANDS = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))


def band(kappa: Column) -> Column:
    """Below 0 poor; to .2 slight; to .4 fair; to .6 moderate; to .8 substantial; else almost perfect."""
    out = F.when(kappa < 0, "poor")
    for top, name in BANDS[1:]:
        out = out.when(kappa <= top, name)
    return F.when(kappa.isNotNull(), out.otherwise("almost perfect"))


def cohen(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of labels -> n, kappa (null where chance agreement is 1).

    All from one table of counts of label pairs; the labels, not the items, are what windows see.
    """
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("n", F.sum("c").over(whole))
    # the other rater's count of the same label
    other = cells.groupBy(*keys, F.col(b).alias("__l")).agg(F.sum("c").alias("cb"))
    one = cells.groupBy(*keys, F.col(a).alias("__l")).agg(F.sum("c").alias("ca"), F.max("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    joined = one.join(other, [*keys, "__l"], "left")
    out = joined.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("same").alias("same"), F.sum(F.col("ca") * F.coalesce("cb", F.lit(0))).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return out.select(*keys, "n", F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe)).alias("kappa"))


def pairwise(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Both labels of each item for every two raters: keys, rater_a, rater_b, item, a, b.

    An item's labels, one for each rater, are gathered once and give its pairs: one shuffle, no self-join.
    """
    return _pairs(_panels(labels, keys), keys)


def _panels(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys, "item").agg(F.array_sort(F.collect_list(F.struct("rater", "label"))).alias("panel"))


def _pairs(panel: DataFrame, keys: list[str]) -> DataFrame:
    pair = lambda x, y: F.struct(x["rater"].alias("rater_a"), y["rater"].alias("rater_b"), x["label"].alias("a"), y["label"].alias("b"))
    pairs = F.flatten(F.transform("panel", lambda x: F.transform(F.filter("panel", lambda y: y["rater"] > x["rater"]), lambda y: pair(x, y))))
    return panel.select(*keys, "item", F.explode(pairs).alias("pair")).select(*keys, "pair.rater_a", "pair.rater_b", "item", "pair.a", "pair.b")


def item_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, counts (label, c): an item's labels but null and how often it has each, an entry for each label."""
    cells = labels.where(F.col("label").isNotNull()).groupBy(*keys, "item", "label").agg(F.count("*").alias("c"))
    return cells.groupBy(*keys, "item").agg(F.collect_list(F.struct("label", "c")).alias("counts"))


def compositions(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts (label, c; in order), items, rows: how many items have the same labels as often, and their rows, null labels included.

    One pass over the labels serves all that is asked of them; what follows meets compositions, not items.
    """
    cells = labels.groupBy(*keys, "item", "label").agg(F.count("*").alias("c"))
    given = F.when(F.col("label").isNotNull(), F.struct("label", "c"))
    own = cells.groupBy(*keys, "item").agg(F.sort_array(F.collect_list(given)).alias("counts"), F.sum("c").alias("rows"))
    return own.groupBy(*keys, "counts").agg(F.count("*").alias("items"), F.sum("rows").alias("rows"))


def _panel_counts(panel: DataFrame, keys: list[str]) -> DataFrame:
    """The same from panels that are gathered already."""
    given = F.filter(F.transform("panel", lambda p: p["label"]), lambda x: x.isNotNull())
    rows = panel.select(*keys, "item", given.alias("given")).where(F.size("given") > 0)
    counts = F.transform(F.array_distinct("given"), lambda x: F.struct(x.alias("label"), F.size(F.filter("given", lambda y: y == x)).cast("long").alias("c")))
    return rows.select(*keys, "item", counts.alias("counts"))


def _sum(of) -> Column:
    return F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + of(x["c"]))


def fleiss(labels: DataFrame, keys: list[str]) -> DataFrame:
    """items, kappa; every item must have the same number of raters. Where chance agreement is 1, kappa is 1."""
    return _fleiss(item_counts(labels, keys), keys)


def _fleiss(counts: DataFrame, keys: list[str]) -> DataFrame:
    per_item = counts.select(*keys, _sum(lambda c: c).alias("n"), _sum(lambda c: c * c).alias("s"))
    per_item = per_item.withColumn("p", (F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    mean = per_item.groupBy(*keys).agg(F.avg("p").alias("p_bar"), F.count("*").alias("items"), F.sum("n").alias("total"))
    share = counts.select(*keys, F.inline("counts")).groupBy(*keys, "label").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"))
    out = mean.join(share, keys) if keys else mean.crossJoin(share)
    pe = F.col("sq") / (F.col("total").cast("double") * F.col("total"))
    return out.select(*keys, "items", F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((F.col("p_bar") - pe) / (1 - pe)).alias("kappa"))


def alpha(labels: DataFrame, keys: list[str], metric: str = "ordinal") -> DataFrame:
    """Krippendorff's alpha: nominal, ordinal, interval or ratio. Null labels and items with one label drop out.

    Coincidences come from counts of labels in an item, not from pairs of raters, within the item's row.
    """
    return _alpha(item_counts(labels, keys), keys, metric)


def _alpha(counts: DataFrame, keys: list[str], metric: str = "ordinal") -> DataFrame:
    return alpha_of(counts.groupBy(*keys, F.sort_array("counts").alias("counts")).agg(F.count("*").alias("items")), keys, metric)


def alpha_of(composed: DataFrame, keys: list[str], metric: str = "ordinal") -> DataFrame:
    """Alpha from compositions: keys, counts, items."""
    o = lambda x, y: x["c"] * (y["c"] - (x["label"] == y["label"]).cast("int")) / (F.col("m") - 1)
    met = F.flatten(F.transform("counts", lambda x: F.transform("counts", lambda y: F.struct(x["label"].alias("x"), y["label"].alias("y"), o(x, y).alias("o")))))
    rows = composed.select(*keys, "counts", "items", _sum(lambda c: c).alias("m")).where("m > 1")
    seen = rows.select(*keys, "items", F.inline(met)).groupBy(*keys, "x", "y").agg(F.sum(F.col("items") * F.col("o")).alias("o"))
    margin = seen.groupBy(*keys, "x").agg(F.sum("o").alias("nx"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    margin = margin.withColumn("upto", F.sum("nx").over(own.orderBy("x"))).withColumn("n", F.sum("nx").over(own))
    other = margin.select(*keys, F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("upto").alias("upto_y"))
    grid = margin.join(other, keys) if keys else margin.crossJoin(other)  # labels by labels
    grid = grid.join(seen, [*keys, "x", "y"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    between = F.abs(F.col("upto") - F.col("upto_y")) + F.when(x <= y, F.col("nx")).otherwise(F.col("ny")) - (F.col("nx") + F.col("ny")) / 2
    delta = {"nominal": (x != y).cast("double"), "ordinal": F.when(x == y, 0.0).otherwise(between), "interval": x - y, "ratio": F.when(x + y == 0, 0.0).otherwise((x - y) / (x + y))}[metric]
    out = grid.withColumn("d", delta * delta).groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("o") * F.col("d")).alias("do"), F.sum(F.col("nx") * F.col("ny") * F.col("d")).alias("de"))
    return out.select(*keys, F.when(F.col("de") > 0, 1 - (F.col("n") - 1) * F.col("do") / F.col("de")).alias("alpha"))


def complete(labels: DataFrame, keys: list[str], raters: int) -> DataFrame:
    """Only the items that all raters have labelled."""
    full = labels.where(F.col("label").isNotNull()).groupBy(*keys, "item").agg(F.countDistinct("rater").alias("k")).where(F.col("k") == raters)
    return labels.join(full.drop("k"), [*keys, "item"], "left_semi")


def report(labels: DataFrame, keys: list[str], gate: float = 0.80) -> DataFrame:
    """Fleiss, ordinal alpha, mean pairwise Cohen, the smallest of them, the band and the gate.

    All three come from the items' panels, whose exchange the plan reuses: labels are made and shuffled once.
    """
    panel = _panels(labels, keys)
    counts = _panel_counts(panel, keys)
    mean = cohen(_pairs(panel, keys), [*keys, "rater_a", "rater_b"]).groupBy(*keys).agg(F.avg("kappa").alias("cohen"))
    parts = [_fleiss(counts, keys).select(*keys, F.col("kappa").alias("fleiss")), _alpha(counts, keys), mean]
    out = reduce(lambda a, b: a.join(b, keys), parts)
    return out.withColumn("lowest", F.least("cohen", "fleiss", "alpha")).withColumn("band", band(F.round("fleiss", 9))).withColumn("passes", F.col("alpha") >= gate)


def semantic(left: DataFrame, right: DataFrame, item: list[str], vector: str, group: str) -> DataFrame:
    """group, p, r, f1, band: vectors of two sides of an item matched greedily by cosine, best for best.

    p is the mean over the left side's vectors of the best cosine on the right, r the reverse. An item's vectors meet
    each other only; they are the tokens of one text.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sides = [t.select(*item, F.monotonically_increasing_id().alias(f"id_{n}"), F.col(vector).alias(n), F.sqrt(dot(vector, vector)).alias(f"norm_{n}")) for t, n in ((left, "a"), (right, "b"))]
    both = sides[0].join(sides[1], item).withColumn("cos", F.try_divide(dot("a", "b"), F.col("norm_a") * F.col("norm_b")))
    best = lambda n: both.groupBy(group, *[c for c in item if c != group], f"id_{n}").agg(F.max("cos").alias("best")).groupBy(group).agg(F.avg("best").alias({"a": "p", "b": "r"}[n]))
    out = best("a").join(best("b"), group).withColumn("f1", F.round(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 9))
    return out.select(group, F.round("p", 9).alias("p"), F.round("r", 9).alias("r"), "f1", F.when(F.col("f1") >= 0.85, "strong").when(F.col("f1") >= 0.7, "acceptable").otherwise("weak").alias("band"))
