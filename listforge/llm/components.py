"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for the ends of links ``a, b``: the least node reachable.

    Every step takes the least label among neighbours and then the label of that label, so a chain
    shrinks by half or more a step.  Each step is a written table; only its number of changes is read.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("best")))
        stepped = stored(labels.join(near, "node").select("node", "label", F.least("label", "best").alias("step")), "step")
        jump = stepped.select(F.col("node").alias("step"), F.col("step").alias("jump"))
        new = stored(stepped.join(jump, "step", "left").select("node", F.col("label").alias("old"), F.least("step", "jump").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels
