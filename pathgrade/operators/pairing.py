"""Two results of the same logs, or two raters of the same items, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import agreement, policy

#: What a run is compared by. Names of metrics and of sides.
METRICS = ("trajectory_success", "tool_invocation_accuracy", "privacy_compliance", "latency_ms", "authority_rate", "weighted_total")
SINGLE, MULTI = "single_agent", "multi_agent"


def paired(single: DataFrame, multi: DataFrame, key: str, metrics: tuple[str, ...] = METRICS, total: str = "weighted_total", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry (of the first result), single_<metric>, multi_<metric>, delta_<metric> (second less first), winner by the total.

    Logs that only one result has are left out (``unpaired`` gives them). A key that a result has twice is an error of
    the result: each of its rows is paired.
    """
    side = lambda t, name, more: t.select(key, *more, *[F.col(m).cast("double").alias(f"{name}_{m}") for m in metrics])
    rows = side(single, "single", carry).join(side(multi, "multi", ()), key)
    rows = rows.withColumns({f"delta_{m}": F.col(f"multi_{m}") - F.col(f"single_{m}") for m in metrics})
    return rows.withColumn("winner", policy.winner(F.col(f"multi_{total}"), F.col(f"single_{total}"), MULTI, SINGLE))


def unpaired(single: DataFrame, multi: DataFrame, key: str) -> DataFrame:
    """key, side: logs that only one result has."""
    one = single.select(key).distinct().withColumn("__a", F.lit(True)).join(multi.select(key).distinct().withColumn("__b", F.lit(True)), key, "full")
    return one.where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), MULTI).otherwise(SINGLE).alias("side"))


def compared(pairs: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, n (pairs with both values), single, multi, delta (means over those), multi_wins, single_wins, ties."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"single_{m}").alias("s"), F.col(f"multi_{m}").alias("m")) for m in metrics])
    long = pairs.select(F.inline(cells)).where("s is not null and m is not null").withColumn("w", policy.winner(F.col("m"), F.col("s"), "m", "s"))
    wins = lambda x: F.sum((F.col("w") == x).cast("long"))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("s").alias("single"), F.avg("m").alias("multi"), F.avg(F.col("m") - F.col("s")).alias("delta"), wins("m").alias("multi_wins"), wins("s").alias("single_wins"), wins("tie").alias("ties"))


def two_raters(first: DataFrame, second: DataFrame, item: str, dims: tuple[str, ...], bins: int = 3, check: bool = True) -> DataFrame:
    """dim, n, kappa: Fleiss' kappa of two raters whose scores (0 to 1) are put into bins.

    A dimension counts the items for which both have a score; one without such an item has no row. Raters of different
    items are an error (``check``: counted first).
    """
    if check and (odd := unpaired(first, second, item).limit(1).count()):
        raise ValueError(f"both raters must have the same items ({odd} or more are of one only)")
    bin_ = lambda x: F.when(x.isNotNull(), F.least(F.floor(x * bins), F.lit(bins - 1))).cast("int")
    both = first.select(item, *[F.col(d).alias(f"a_{d}") for d in dims]).join(second.select(item, *[F.col(d).alias(f"b_{d}") for d in dims]), item)
    cells = F.array(*[F.struct(F.lit(d).alias("dim"), bin_(F.col(f"a_{d}")).alias("a"), bin_(F.col(f"b_{d}")).alias("b")) for d in dims])
    rows = both.select(F.col(item).alias("item"), F.inline(cells)).where("a is not null and b is not null")
    long = rows.select("dim", "item", F.inline(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in "ab"])))
    return agreement.fleiss(long, ["dim"]).select("dim", F.col("items").alias("n"), "kappa")


def mean_agreement(kappas: DataFrame) -> DataFrame:
    """kappa: the mean over dimensions; 0 where there is none."""
    return kappas.agg(F.coalesce(F.avg("kappa"), F.lit(0.0)).alias("kappa"))
