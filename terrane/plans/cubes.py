"""Queries of volumes: dips, coherency, dip filters and horizon tracking over events as traces side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import bricks, tracking
from terrane.plans.registry import query, r
from terrane.plans.views import T, load


def volume(spark, sf):
    """events as a volume: 25 users an inline, samples by time."""
    rows = load(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select(F.floor(F.col("user_id") / 25).alias("inl"), (F.col("user_id") % 25).alias("crl"), F.col("s.value").alias("samples"))


def _samples(df, *names, digits=6):
    each = df.select("inl", "crl", F.posexplode(F.arrays_zip(*names)).alias("z", "s"))
    return each.select("inl", "crl", "z", *(r(F.col(f"s.{n}"), digits).alias(n) for n in names))


@query()
def q_dip_scan(spark, sf):
    return _samples(bricks.dip_scan(volume(spark, sf), 1.0, 0.5, 1, 3), "coherency", "inl_dip", "crl_dip")


@query()
def q_gradient_dip(spark, sf):
    return _samples(bricks.gradient_dip(volume(spark, sf), 2, 3), "inl_dip", "crl_dip", "planarity")


@query()
def q_eigen_coherency(spark, sf):
    return _samples(bricks.eigen_coherency(volume(spark, sf), 1, 3, 0), "coherency")


@query(f"""WITH {T}, v AS (SELECT trace // 25 AS inl, trace % 25 AS crl, z_idx AS z, val FROM t),
o AS (SELECT i, j, k, CASE WHEN i = 0 AND j = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 - 0.5 * cos(pi() * greatest(0, least(1, (1 - abs(k) / sqrt(i * i + j * j)) / 0.2))) END AS w FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k))
SELECT v.inl, v.crl, v.z, round(sum(w * coalesce(n.val, 0)) / (SELECT sum(w) FROM o), 6) AS filtered FROM v CROSS JOIN o JOIN v n ON n.inl = v.inl + i AND n.crl = v.crl + j AND n.z = v.z + k GROUP BY 1, 2, 3""")
def q_dip_filter(spark, sf):
    return _samples(bricks.dip_filter(volume(spark, sf), 3, None, 1.0, 0.2), "filtered")


@query()
def q_steered_smoother(spark, sf):
    return _samples(bricks.steered_smoother(volume(spark, sf), 1, 2, 3), "smoothed")


@query()
def q_horizon_tracking(spark, sf):
    """From the highest sample of every tenth trace."""
    v = volume(spark, sf)
    seeds = v.where("(inl + crl) % 10 = 0").select("inl", "crl", (F.array_position("samples", F.array_max("samples")) - 1).alias("z"))
    return tracking.track(v, seeds, 2, 6, 0.85)
