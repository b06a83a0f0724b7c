"""Connected components by alternating star operations: joins and minima only, lineage cut after each round.

Cases: links of a node with itself and repeated links add nothing; nodes without links to others are not in the result; without
edges it is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import release, settled


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of edges (u, v). Nodes of one size only: no node is collected."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = settled(edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    before = None
    while True:
        # Large star: every larger neighbour moves to the smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        moved = both.join(least, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every smaller neighbour and the node itself move to the smallest one.
        least = moved.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        joined = moved.join(least, F.col("u") == F.col("n"))
        edges = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        edges = settled(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        del both, least, moved, joined
        release(edges.sparkSession)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return settled(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots))
