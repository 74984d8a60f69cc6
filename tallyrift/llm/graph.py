"""Connected components of links that lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b): root is its component's smallest node.

    Each round every node takes the smallest label among its neighbours' and then its label's own label, so paths halve.
    Labels are written each round; none of it comes to the driver but whether anything changed. A node with very many
    links is a hot key of a join whose other side is unique, which Spark splits.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        took = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        took = written(took, "labels")
        far = took.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(took.join(far, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("old != root").isEmpty():
            return labels
    raise RuntimeError(f"components of a path longer than {rounds} halvings")
