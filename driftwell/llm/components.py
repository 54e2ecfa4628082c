"""Connected components of a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """links: a, b.  Returns node, label for every node with a link; label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so rounds grow with
    the logarithm of a component's diameter.  A hub's neighbours are aggregated before they are shuffled.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        now = saved(step.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        if now.where("new <> label").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", F.col("new").alias("label"))
