"""Connected components by least labels and pointer jumping, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node of its component.

    Each round takes the least label of all neighbours, then the label's own label, so paths halve.  Labels are unique by
    node, so a hub only lengthens the other side of a join, which Spark splits, and aggregates are combined before a shuffle.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = stored(least.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels
