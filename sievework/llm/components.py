"""Connected components of a graph given by its links, on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """Links (x, y) to labels (node, label): the smallest node reachable. Nodes without links have no row.

    Every round gives a node the smallest label among its neighbours' and then
    the label of that label, so long chains shrink by jumps. The number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = materialize(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.least("label", "low").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = materialize(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
