"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows hooks to their roots by pointer
    doubling, and contracts the links to roots. At least half of the nodes that still have links vanish in a
    round, so rounds are at most the logarithm of the nodes, whatever the shape. Links, hooks and labels stay
    in tables; counts alone come to the driver.
    """
    edges = scratch.put(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.put(hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
            still = jumped.where("moved").isEmpty()
            scratch.drop(hooks, small=True)
            hooks = jumped.select("node", "root")
            hooks._scratch_path = jumped._scratch_path
            if still:
                break
        to = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        ends = edges.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        contracted = scratch.put(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if labels is None:
            labels = hooks
        else:
            old = labels
            labels = scratch.put(old.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            scratch.drop(old, hooks, small=True)
        scratch.drop(edges)
        edges = contracted
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return labels.select("node", F.col("root").alias("component"))
