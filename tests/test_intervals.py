"""Points in intervals against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import positions


def test_within_of_any_length(spark):
    rng = np.random.default_rng(4)
    low = rng.uniform(-50, 50, 120)
    length = rng.choice([0.0, 1e-9, 0.3, 2.0, 40.0, 700.0, -1.0], 120)
    spans = [(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(low, length))] + [(900, None, 1.0), (901, 1.0, None)]
    xs = [float(x) for x in rng.uniform(-60, 60, 200)] + [a for _, a, _ in spans[:40]] + [b for _, _, b in spans[40:80]]
    points = [(k, x) for k, x in enumerate(xs)] + [(9000, None)]
    got = positions.within(spark.createDataFrame(points, "k long, x double"), "x", spark.createDataFrame(spans, "i long, low double, high double"), "low", "high", 100.0)
    assert got.columns == ["k", "x", "i", "low", "high"]
    want = [(k, i) for k, x in points[:-1] for i, a, b in spans[:-2] if a <= x <= b]
    assert sorted((r.k, r.i) for r in got.collect()) == sorted(want)
    none = spark.createDataFrame([], "i long, low double, high double")
    assert positions.within(spark.createDataFrame(points, "k long, x double"), "x", none, "low", "high", 100.0).count() == 0


def test_within_spreads_what_lies_together(spark):
    """Points and intervals in one place are no work of a single task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.range(4000).select("id", (F.lit(20.0) + F.col("id") % 7).alias("x"))
        spans = spark.range(50).select(F.col("id").alias("i"), (10.0 + F.col("id") / 100.0).alias("low"), F.lit(50.0).alias("high"))
        shares = positions.within(points, "x", spans, "low", "high", 100.0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in shares) == 4000 * 50 and len(shares) > 1
