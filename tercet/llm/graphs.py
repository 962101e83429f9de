"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to (node, component): the smallest node that can be reached.

    Every round takes the smallest label among a node and its neighbours (pre-aggregated, so a hub
    is no hot task), then replaces each label by its own label; rounds grow with the logarithm of
    a chain's length. Labels are written each round; only the number of changes reaches the driver.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("jumped"))
        new = written(lower.join(jump, "lower", "left").select("node", F.least("lower", F.coalesce("jumped", "lower")).alias("component"), (F.col("component") != F.least("lower", F.coalesce("jumped", "lower"))).alias("changed")), "labels")
        forget(labels)
        labels = new
        if not labels.filter("changed").limit(1).count():
            forget(edges)
            return labels.select("node", "component")
