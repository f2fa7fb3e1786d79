"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``edges`` (a, b) of longs to (node, label): the smallest node of its component.

    Every round each node takes the smallest label around it, then the label of
    that label, so stars and chains both shrink fast.  Rounds are written to the
    shared folder; neighbours meet in joins that adaptive execution can split
    and minima combine before the shuffle, so a node with very many edges does
    not land in one task.  Null ends and loops are ignored; an empty table
    gives an empty one.
    """
    pairs = stage(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{purpose}-pairs")
    # Every node keeps the edge to its smallest neighbour only and hands that
    # neighbour on to the others, which leaves little more than a tree.
    least = stage(pairs.groupBy("a").agg(F.min("b").alias("m")), f"{purpose}-least")
    handed = pairs.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select("a", F.col("m").alias("b")).union(handed.distinct())
    both = stage(kept.union(kept.select("b", "a")).distinct(), f"{purpose}-edges")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")), f"{purpose}-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = stage(
            labels.join(near, "node", "left")
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{purpose}-labels")
        over = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = stage(
            lower.join(over, "label", "left")
            .select("node", "old", F.least("label", "up").alias("label")), f"{purpose}-labels")
        if labels.filter("old <> label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
