"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written


def components(edges: DataFrame, rounds: int = 60, stored: bool = False) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; the label is the least node of its component.

    Each round takes the least label among neighbours and then jumps to that label's own label, so
    that rounds grow with the logarithm of a path's length. Loops and repeated edges do no harm.
    ``stored``: the edges are a written table, so they need not be written again.
    """
    edges = edges.select("a", "b")
    edges = edges if stored else written(edges.distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = written(step.join(up, "label", "left").select("node", "old", F.least("label", "above").alias("label")))
        labels = step.select("node", "label")
        if step.filter("label != old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
