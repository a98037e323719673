"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import compacted, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges(a, b)``; label is the smallest node of the component.

    Each round takes the smallest label among a node's neighbours, then the label of that label (pointer jumping), so
    rounds grow with the logarithm of the longest path, about.  All state stays in tables.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = compacted(both)
    first = compacted(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    labels, kept = first, [first]
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = near_step = compacted(step)
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = compacted(step.join(hop, "label", "left").select("node", F.least("label", "next").alias("label"), (F.least("label", "next") != F.col("old")).alias("moved")))
        release(near_step, *kept)
        labels, kept = step.select("node", "label"), [step]
        if step.filter("moved").isEmpty():
            release(both)
            return labels
