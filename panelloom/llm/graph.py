"""Connected components of a graph of any size, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.sources.storage import stage


def components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """node, root: the smallest node reachable from each node of (a, b).

    Each round takes the smallest root among a node's neighbours and then that root's own
    root, so the rounds grow with the logarithm of a component's diameter; each is
    written to the shared folder, so the lineage stays short.
    """
    pairs = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).filter("a <> b")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", True)
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels", True)
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("heard"))
        lower = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        roots = labels.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = lower.join(roots, lower["root"] == roots["at"], "left").select(
            "node", "before", F.least("root", F.coalesce("above", "root")).alias("root"))
        found = stage(jumped, "labels", True)
        if not found.filter("before <> root").limit(1).count():
            return found.select("node", "root")
        labels = found.select("node", "root")
