"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b), a row for each linked node: node, component, the least node it reaches.

    Each round every node takes the least component among its own and its
    neighbours', then the component of that (pointer jumping); rounds grow with
    the logarithm of a component's breadth, not with its size.  Sums and minima
    are combined before the shuffle, so a node with very many links is no hot
    spot; rounds are cut by checkpoints in the shared folder.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(around, labels["node"] == around["a"]).select("node", "component", F.least("component", "near").alias("next"))
        # The representative may itself have moved on.
        target = labels.select(F.col("node").alias("t"), F.col("component").alias("t_component"))
        jumped = closer.join(target, closer["next"] == target["t"], "left").select("node", "component", F.least("next", F.coalesce("t_component", "next")).alias("next"))
        moved = checkpointed(jumped)
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.where("next <> component").isEmpty():
            return labels
