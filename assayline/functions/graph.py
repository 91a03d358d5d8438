"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; component is the least node reachable.

    Each round takes the least label among a node's neighbours and then jumps to
    that label's own label, so rounds grow with the logarithm of the diameter.
    A round is three equi-joins, checkpointed. Edges may repeat or be loops; null
    ends are dropped; an empty table gives an empty result.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    pairs = cut(edges.where("a <> b").union(edges.where("a <> b").select("b", "a")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut(
        nodes.join(
            pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "node", "left"
        ).select("node", F.coalesce(F.least("node", "least"), "node").alias("component"))
    )
    for _ in range(max_rounds):
        around = (
            pairs.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("around"))
        )
        # A node's new label also reaches the node that named its old label.
        told = (
            labels.join(around, "node")
            .groupBy(F.col("component").alias("node"))
            .agg(F.min("around").alias("told"))
        )
        heard = (
            labels.join(around, "node", "left")
            .join(told, "node", "left")
            .select(
                "node",
                F.col("component").alias("was"),
                F.least("component", F.coalesce("around", "component"), F.coalesce("told", "component")).alias("now"),
            )
        )
        heard = cut(heard)
        jumped = cut(
            heard.join(heard.select(F.col("node").alias("now"), F.col("now").alias("beyond")), "now", "left").select(
                "node", "was", F.least("now", F.coalesce("beyond", "now")).alias("component")
            )
        )
        moved = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
