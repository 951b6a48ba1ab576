"""Connected components of a graph given as edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges stay the same, which
    takes about as many rounds as the logarithm of the longest path. Each step is
    a minimum per node, pre-aggregated, and a join with that small side, so a node
    with very many edges is no single task's burden. Rounds are stored, and only
    counts come to the driver. Self-loops and repeated edges change nothing.
    """
    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct())
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
