"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.llm.storage import materialize


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node reachable.

    A round takes the smallest label next to each node (a map-side minimum, so a
    node with many edges gathers nothing), then follows labels once more.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old"))
        lowered = materialize(lowered, name)
        target = lowered.select(F.col("node").alias("at"), F.col("new").alias("further"))
        jumped = lowered.join(target, lowered["new"] == target["at"], "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), "old")
        jumped = materialize(jumped, name)
        labels = jumped.select("node", "label")
        if jumped.filter("label < old").isEmpty():
            return labels
