"""The driver's tables seen as traces, gathers, grids, horizons, logs and points; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as traces: trace = user_id, z_idx by time, val = value."""
    e = load(spark, sf_dir, "events")
    z = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("trace"), z.alias("z_idx"), F.col("value").alias("val"), "event_type", "event_id", "ts")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cells: inl = l_suppkey, crl = l_linenumber, z = year of l_shipdate, val = mean price in thousands."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("inl"), F.col("l_linenumber").cast("long").alias("crl"), F.year("l_shipdate").cast("long").alias("z")).agg(F.round(F.avg("l_extendedprice") / 1000, 3).alias("val"))


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as horizons: hor = order status, pos = customer mod 200, z = mean price in thousands."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("hor"), (F.col("o_custkey") % 200).alias("pos")).agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("z"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as well logs: well = user_id, log = event_type, dah = z_idx."""
    return traces(spark, sf_dir).select(F.col("trace").alias("well"), F.col("event_type").alias("log"), F.col("z_idx").cast("double").alias("dah"), "val")


T = "t AS (SELECT user_id AS trace, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS z_idx, value AS val, event_type, event_id, ts FROM events)"
G = "g AS (SELECT l_suppkey AS inl, CAST(l_linenumber AS BIGINT) AS crl, CAST(year(l_shipdate) AS BIGINT) AS z, round(avg(l_extendedprice) / 1000, 3) AS val FROM lineitem GROUP BY ALL)"
H = "h AS (SELECT o_orderstatus AS hor, o_custkey % 200 AS pos, round(avg(o_totalprice) / 1000, 3) AS z FROM orders GROUP BY ALL)"
L = f"{T}, l AS (SELECT trace AS well, event_type AS log, CAST(z_idx AS DOUBLE) AS dah, val FROM t)"
