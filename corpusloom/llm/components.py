"""Connected components by contraction, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """(a, b) links -> node, label: a label for each node of a link, the same for all that links connect.

    In each step every node takes the smallest name around it, and links are renamed by what their ends took;
    links inside one name vanish. Links stay as many as they were or fewer, a long chain takes steps as the
    logarithm of its length, and a node with very many links is one partial minimum a task. Tables of a step
    are written to the shared folder, so lineage is one step long.
    """
    pairs = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(links.where("a <> b").select(*pairs(F.col("a"), F.col("b"))).distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for step in range(max_steps):
        both = edges.select("a", "b").unionAll(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("a", "least").alias("to"))
        one, two = parents.select(F.col("of").alias("of_a"), F.col("to").alias("to_a")), parents.select(F.col("of").alias("of_b"), F.col("to").alias("to_b"))
        labels_next = labels.join(parents, F.col("label") == F.col("of"), "left").select("node", F.coalesce("to", "label").alias("label"))
        renamed = edges.join(one, F.col("a") == F.col("of_a")).join(two, F.col("b") == F.col("of_b")).where("to_a <> to_b").select(*pairs(F.col("to_a"), F.col("to_b"))).distinct()
        old = (edges, labels if step else None)
        edges, labels = materialize(renamed, f"links-{step}"), materialize(labels_next, f"labels-{step}")
        for t in old:
            if t is not None:
                discard(t)
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_steps} steps")
