"""Groups of rows that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written


def components(links: DataFrame, max_steps: int = 100) -> DataFrame:
    """(a, b) -> node, label: a label for each node of a link, the same for all that links connect.

    In each step every node takes the name around it that a hash of name and step puts first, and links are renamed by what their ends
    took; links inside one name vanish. The order is a new one in each step, so a chain loses a share of its names whatever they are, and one of
    n nodes takes steps as the logarithm of n. Each step is written; a node of very many links is one partial minimum a task.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "group-links")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "group-labels")
    for step in range(max_steps):
        if edges.isEmpty():
            drop(edges)
            return labels
        both = edges.select("a", "b").unionAll(edges.select("b", "a"))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("p"), F.col(c).alias("name"))
        parents = both.groupBy("a").agg(F.min(place("b")).alias("x")).select(F.col("a").alias("of"), F.least("x", place("a"))["name"].alias("to"))
        parents = written(parents, "group-parents")
        end = lambda x: parents.select(F.col("of").alias(f"of_{x}"), F.col("to").alias(f"to_{x}"))
        renamed = edges.join(end("a"), F.col("a") == F.col("of_a")).join(end("b"), F.col("b") == F.col("of_b")).where("to_a <> to_b")
        new = written(renamed.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "group-links")
        now = written(labels.join(parents, F.col("label") == F.col("of"), "left").select("node", F.coalesce("to", "label").alias("label")), "group-labels")
        for t in (edges, labels, parents):
            drop(t)
        edges, labels = new, now
    raise RuntimeError(f"groups did not settle in {max_steps} steps")
