"""Queries of surfaces through scattered points: triangles, gridding, contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import bending, contours, curvature_grid, triangles
from terrane.plans.registry import query, r
from terrane.plans.views import load


def _points(spark, sf):
    """Customers as points: x = balance, y = key."""
    return load(spark, sf, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), "c_custkey")


@query()
def q_delaunay_triangles(spark, sf):
    return triangles.delaunay(_points(spark, sf))


@query()
def q_triangulated_gridding(spark, sf):
    """The mean order price of customers, gridded to where each order lies."""
    orders = load(spark, sf, "orders")
    mean = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("val"))
    known = _points(spark, sf).join(mean, "c_custkey")
    targets = orders.select("o_orderkey", (F.col("o_totalprice") / 50).alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return triangles.interpolate(known, targets).select("o_orderkey", r("val", 4).alias("val"))


@query()
def q_curvature_gridding(spark, sf):
    """Mean order prices by tens of customers and day of year: days without orders are filled by minimum curvature."""
    orders = load(spark, sf, "orders")
    nodes = orders.groupBy(F.floor(F.col("o_custkey") / 10).alias("inl"), F.dayofyear("o_orderdate").alias("crl")).agg((F.avg("o_totalprice") / 1000).alias("val"))
    return curvature_grid.fill(nodes, 0.25, 1e-7).select("inl", "crl", r("val", 3).alias("val"), "known")


@query()
def q_contour_lines(spark, sf):
    """Mean prices by supplier and line, where they cross the mean of all."""
    li = load(spark, sf, "lineitem")
    grid = li.groupBy(F.col("l_suppkey").alias("inl"), F.col("l_linenumber").alias("crl")).agg((F.avg("l_extendedprice") / 1000).alias("val"))
    level = li.agg(F.avg("l_extendedprice") / 1000).first()[0]
    if level is None:
        level = 0.0
    return contours.contour_lines(grid, level).select("line", "closed", "seq", r("inl").alias("inl"), r("crl").alias("crl"))


@query()
def q_fault_surfaces(spark, sf):
    """Customers' orders as sticks of a fault for each nation and segment: a stick a customer, its points by date."""
    customer = load(spark, sf, "customer").select(F.concat_ws(" ", "c_nationkey", "c_mktsegment").alias("fault"), F.col("c_custkey").alias("stick"), "c_acctbal")
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("stick"), F.col("o_orderkey").alias("seq"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("at"), "o_totalprice")
    points = customer.join(orders, "stick").select("fault", "stick", "seq", F.col("stick").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"), F.col("at").cast("double").alias("z"))
    return bending.fault_surfaces(points)
