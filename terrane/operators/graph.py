"""Connected components and relations of few large tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import more_parts, written


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of edges (u, v): least labels spread along edges, then along labels, until
    nothing changes; rounds grow with the logarithm of a component's width. Shuffles have more parts as edges grow."""
    spark = edges.sparkSession
    with more_parts(spark, 2 * edges.count()):
        both = written(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
        while True:
            near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("n"))
            spread = labels.join(near, "u").select("u", F.least("c", "n").alias("c"), F.col("c").alias("old"))
            jump = spread.select(F.col("u").alias("c"), F.col("c").alias("further"))
            new = written(spread.join(jump, "c", "left").select("u", F.coalesce("further", "c").alias("c"), "old"))
            if new.where("c != old").isEmpty():
                return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
            labels = new.select("u", "c")
