"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is its smallest node.

    Alternates hooking every neighbour to the smallest one around a node and
    shortening those paths, so the number of rounds grows with the logarithm of
    the longest chain. Each round is a written table; a node with very many
    neighbours is only ever aggregated (its minimum), never collected. Self
    loops name isolated nodes, null ends are ignored. No edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = stored(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not links.isEmpty():
        # large star: neighbours above a node point to the smallest node around it
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node and the nodes below it point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")
        ).where("u <> v").distinct()
        nxt = stored(small, "links")
        # finished when every node has one parent and no parent has a parent
        open_ = nxt.select("v").join(nxt.select(F.col("u").alias("v")), "v", "left_semi")
        done = open_.isEmpty() and nxt.groupBy("u").count().where("count > 1").isEmpty()
        links = nxt
        if done:
            break
    root = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
