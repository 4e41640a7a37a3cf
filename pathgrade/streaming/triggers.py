"""Review triggers on a stream of events: the checks need one step at a time, so no state; counts come in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triggers import with_trigger


def triggered(stream: DataFrame) -> DataFrame:
    """Steps (ts, action, confidence) of a stream that a human must look at."""
    return with_trigger(stream).where("trigger_type is not null")


def counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Triggers by window and type, closed once the watermark has passed."""
    return triggered(stream).withWatermark("ts", late).groupBy(F.window("ts", window), "trigger_type").agg(F.count("*").alias("n"))
