"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.tables import written


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (greater ones in a large step, smaller ones in a small step) go to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root: the least node reachable) for every node of edges (u, v: longs), in O(log n) rounds; each round is
    written to the shared folder. Loops and repeated edges do no harm; nulls must not occur."""
    nodes = written(edges.select("u", "v").where("u != v").distinct())
    edges, before = nodes, None
    while True:
        edges = written(_step(_step(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
