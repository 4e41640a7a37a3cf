"""Connected components of links, and where their rounds are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint: cuts the lineage and survives lost executors. The folder is spark.checkpoint.dir; on one machine,
    where it is unset, a temporary one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="pathgrade-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) -> id, component: the smallest id that links reach. Ids without a link have no row.

    In each round an id takes the smallest label among its neighbours, and then the label that this label has. Minima
    combine before they are shuffled; a hub's links meet its one label in a join that adaptive execution may split.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a"))
    both = kept(both.distinct())
    now = kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = now.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = kept(step.join(jump, "label", "left").select("id", "was", F.least("label", "further").alias("label")))
        now = step.select("id", "label")
        if step.where("was <> label").isEmpty():
            return now.select("id", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
