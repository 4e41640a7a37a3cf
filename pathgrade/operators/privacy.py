"""Gaussian noise for sensor values, its budget, and records that consent keeps as they are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    """Deviation of the Gaussian mechanism."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("epsilon must be positive and delta in (0, 1)")
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def sigma_of(sensitivity: Column, epsilon: Column, delta: Column) -> Column:
    return sensitivity * F.sqrt(2 * F.log(1.25 / delta)) / epsilon


def gaussian(key: Column, seed: int) -> Column:
    """A standard normal number that depends only on the key and the seed (Box and Muller), so reruns agree."""
    u = lambda s: ((F.xxhash64(F.lit(s), key).bitwiseAND(F.lit((1 << 53) - 1))) + 1).cast("double") / float(1 << 53)
    return F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * math.pi * u(seed + 1))


def sanitise(rows: DataFrame, key: str, epsilon: float, delta: float, seed: int = 0, consent: str = "consent") -> DataFrame:
    """Noise on the known columns; other columns, and rows with revoked consent, pass unchanged."""
    known = [c for c in rows.columns if c in K.SENSITIVITIES]
    noisy = {c: F.when(F.col(consent) == "revoked", F.col(c)).otherwise(F.col(c) + sigma(K.SENSITIVITIES[c], epsilon, delta) * gaussian(F.concat_ws(":", F.col(key).cast("string"), F.lit(c)), seed)) for c in known}
    return rows.withColumns(noisy) if noisy else rows


def budget(spent: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """What has been spent, and whether it is within the budget."""
    return spent.groupBy(*keys).agg(F.sum("epsilon").alias("spent")).withColumn("within", F.round("spent", 9) <= epsilon)


def clipped_means(events: DataFrame, session: str, values: dict[str, tuple[float, float]], epsilon: float, delta: float) -> DataFrame:
    """session, n, and of each of ``values`` (column: bounds) the mean of its clipped values and sigma_<column>, the noise due to it.

    A value is clipped to its bounds before it is averaged, so one event moves a mean of n by at most (high - low) / n:
    the noise's sensitivity. Null and non-finite values do not count; without any, mean and noise are null.
    """
    fine = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))) for c, (low, high) in values.items()}
    of = lambda c, x: [F.avg(x).alias(c), (F.lit(sigma(values[c][1] - values[c][0], epsilon, delta)) / F.nullif(F.count(x), F.lit(0))).alias(f"sigma_{c}")]
    return events.groupBy(session).agg(F.count("*").alias("n"), *[a for c, x in fine.items() for a in of(c, x)])


def stream_summary(events: DataFrame, session: str, values: dict[str, tuple[float, float]], epsilon: float, delta: float, seed: int = 0) -> DataFrame:
    """A differentially private summary of each session's stream: session, n, and the noised mean of each of ``values``.

    The noise depends on session, column and seed only, so reruns agree.
    """
    noisy = {c: F.col(c) + F.col(f"sigma_{c}") * gaussian(F.concat_ws(":", F.col(session).cast("string"), F.lit(c)), seed) for c in values}
    return clipped_means(events, session, values, epsilon, delta).withColumns(noisy).select(session, "n", *values)


def described(summary: DataFrame, values: dict[str, tuple[float, float]], bands: tuple[str, ...] = ("low", "middle", "high")) -> Column:
    """A summary's row as text: each value's name and its band within the bounds."""
    parts = []
    for c, (low, high) in values.items():
        at = F.floor((F.col(c) - low) / (high - low) * len(bands))
        band = F.get(F.array(*[F.lit(b) for b in bands]), F.greatest(F.lit(0), F.least(F.lit(len(bands) - 1), at)).cast("int"))
        parts.append(F.concat(F.lit(f"{c} "), band, F.lit(f" {c}-"), band))
    return F.concat_ws(" ", *parts)


def private_grounding(responses: DataFrame, summary: DataFrame, session: str, response: str, values: dict[str, tuple[float, float]], least: float = 0.65) -> DataFrame:
    """session, ppg (share of the response's sentences with a word of the private summary), passes. A session without a summary has no words."""
    told = summary.select(session, described(summary, values).alias("__told"))
    rows = responses.join(told, session, "left").withColumn("ppg", T.sentence_overlap(F.col(response), T.word_set(F.col("__told"))))
    return rows.select(session, "ppg", (F.col("ppg") >= least).alias("passes"))
