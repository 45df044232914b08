"""Queries of layer models, time-depth relations, regular sampling, contours, statics and tables in plain text."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import earth, models, positions
from terrane.plans.registry import query, r
from terrane.plans.views import G, H, L, T, grid, horizons, load, logs
from terrane.plans.views import traces as trace_view
from terrane.sources import text
from terrane.sources.tables import parts_for, scratch

#: lineitem as elastic layers: the lines of an order, from top to bottom.
E = "m AS (SELECT l_orderkey AS model, l_linenumber AS layer, sum(l_quantity) AS thickness, 1500 + 30.0 * max(l_quantity) AS vp, 700 + 16.0 * max(l_quantity) AS vs, 2000 + 3000 * max(l_discount) AS rho FROM lineitem GROUP BY ALL)"
ANGLE = math.radians(20)


def _layers(spark, sf):
    """The models' lines are dealt out once, so that a task has a bounded number of them, for all steps by model."""
    q, li = F.max("l_quantity"), load(spark, sf, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").repartition(parts_for(spark, li.count()), "l_orderkey")
    return rows.groupBy(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("layer")).agg(F.sum("l_quantity").alias("thickness"), (1500 + 30.0 * q).alias("vp"), (700 + 16.0 * q).alias("vs"), (2000 + 3000 * F.max("l_discount")).alias("rho"))


@query(f"""WITH {E}, n AS (SELECT *, lead(vp) OVER w AS vp2, lead(vs) OVER w AS vs2, lead(rho) OVER w AS rho2, {math.sin(ANGLE)!r}::DOUBLE / vp AS p FROM m WINDOW w AS (PARTITION BY model ORDER BY layer)),
q AS (SELECT *, sqrt(1 / (vp * vp) - p * p) AS q1, sqrt(1 / (vp2 * vp2) - p * p) AS q2, sqrt(1 / (vs * vs) - p * p) AS s1, sqrt(1 / (vs2 * vs2) - p * p) AS s2 FROM n WHERE p * vp2 < 1),
c AS (SELECT *, rho2 * (1 - 2 * vs2 * vs2 * p * p) - rho * (1 - 2 * vs * vs * p * p) AS a, rho2 * (1 - 2 * vs2 * vs2 * p * p) + 2 * rho * vs * vs * p * p AS b, rho * (1 - 2 * vs * vs * p * p) + 2 * rho2 * vs2 * vs2 * p * p AS c, 2 * (rho2 * vs2 * vs2 - rho * vs * vs) AS d FROM q)
SELECT model, layer, round(((b * q1 - c * q2) * (b * s1 + c * s2) - (a + d * q1 * s2) * (a - d * q2 * s1) * p * p) / ((b * q1 + c * q2) * (b * s1 + c * s2) + (a - d * q1 * s2) * (a - d * q2 * s1) * p * p), 8) AS pp FROM c""")
def q_zoeppritz(spark, sf):
    rows = models.below(_layers(spark, sf), ["vp", "vs", "rho"])
    c = F.col
    rows = rows.withColumn("pp", models.zoeppritz(c("vp"), c("vs"), c("rho"), c("next_vp"), c("next_vs"), c("next_rho"), F.lit(ANGLE)))
    return rows.where("pp IS NOT NULL").select("model", "layer", r("pp", 8).alias("pp"))


@query(f"WITH {E}, t AS (SELECT model, layer, vp, sum(2 * thickness / vp) OVER w AS t0, sqrt(sum(2 * thickness * vp) OVER w / sum(2 * thickness / vp) OVER w) AS vrms FROM m WINDOW w AS (PARTITION BY model ORDER BY layer)), x AS (SELECT *, unnest([0.0, 50.0, 400.0])::DOUBLE AS x FROM t), n AS (SELECT *, sqrt(t0 * t0 + x * x / (vrms * vrms)) AS twt FROM x), s AS (SELECT *, x * vp / (vrms * vrms * twt) AS sine FROM n) SELECT model, layer, x AS \"offset\", round(twt, 8) AS twt, round(asin(CASE WHEN sine <= 1 THEN sine END), 6) AS angle FROM s")
def q_ray_trace(spark, sf):
    return models.rays(_layers(spark, sf), [0.0, 50.0, 400.0]).select("model", "layer", "offset", r("twt", 8).alias("twt"), r("angle").alias("angle"))


@query("WITH s AS (SELECT o_custkey AS k, (o_totalprice / 10000) / 4 AS u, o_orderkey % 7 - 3 AS v FROM orders), w AS (SELECT k, CAST(floor(u) AS BIGINT) AS sample, v * (1 - (u - floor(u))) AS v, 1 - (u - floor(u)) AS w FROM s UNION ALL SELECT k, CAST(floor(u) AS BIGINT) + 1, v * (u - floor(u)), u - floor(u) FROM s) SELECT k AS trace, sample, round(sum(v), 8) AS spike FROM w WHERE w > 0 GROUP BY ALL")
def q_reflectivity_sampling(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("trace"), (F.col("o_totalprice") / 10000).alias("t"), (F.col("o_orderkey") % 7 - 3).alias("spike"))
    return models.sampled_spikes(o, "trace", "t", "spike", 4.0).select("trace", "sample", r("spike", 8).alias("spike"))


@query("SELECT CAST(m AS INTEGER) AS model, s_suppkey AS unit, round(10 + s_nationkey + 5 * m / 4.0, 6) AS thickness, round(2000 + s_acctbal / 10 - s_acctbal / 20 * m / 4.0, 6) AS vel FROM supplier, range(5) t(m)")
def q_layer_generator(spark, sf):
    s = load(spark, sf, "supplier")
    first, last = {"thickness": 10.0 + F.col("s_nationkey"), "vel": 2000 + F.col("s_acctbal") / 10}, {"thickness": 15.0 + F.col("s_nationkey"), "vel": 2000 + F.col("s_acctbal") / 20}
    units = s.select(F.col("s_suppkey").alias("unit"), *[c.alias(f"{p}_{i}") for i, cs in enumerate((first, last)) for p, c in cs.items()])
    return models.generated_layers(units, 5, ["thickness", "vel"]).select("model", "unit", r("thickness").alias("thickness"), r("vel").alias("vel"))


# ---- regular sampling, time and depth

#: Five metres in feet.
STEP = "(5 / 0.3048::DOUBLE)"
BETWEEN = "SELECT *, CAST(unnest(range(CAST(ceil(a / {s}) AS BIGINT), CASE WHEN b IS NULL THEN CAST(floor(a / {s}) AS BIGINT) + 1 ELSE CAST(ceil(b / {s}) AS BIGINT) END)) AS BIGINT) AS k FROM {t}"
LERP = "round(v + coalesce((k * {s} - a) / (b - a) * (w - v), 0), 6)"


@query(f"WITH {T}, d AS (SELECT trace, z_idx, val, round(CAST(sum(20 + val) OVER (PARTITION BY trace ORDER BY z_idx) AS DOUBLE), 4) AS depth FROM t), o AS (SELECT trace, depth AS a, val AS v, lead(depth) OVER w AS b, lead(val) OVER w AS w FROM d WINDOW w AS (PARTITION BY trace ORDER BY z_idx)), k AS ({BETWEEN.format(s=STEP, t='o')}) SELECT trace, k, {LERP.format(s=STEP)} AS val FROM k")
def q_time_depth_stretch(spark, sf):
    v = trace_view(spark, sf).select("trace", "z_idx", "val", (20 + F.col("val")).alias("speed"))
    depth = positions.running_total(v, "trace", "z_idx", "speed", 16).withColumn("depth", r("total", 4))
    return models.stretched(depth, 5 / 0.3048).select("trace", "k", r("val").alias("val"))


@query(f"WITH {L}, o AS (SELECT well, log, dah AS a, val AS v, lead(dah) OVER w AS b, lead(val) OVER w AS w FROM l WINDOW w AS (PARTITION BY well, log ORDER BY dah)), k AS ({BETWEEN.format(s='1.5::DOUBLE', t='o')}) SELECT well, log, k, {LERP.format(s='1.5::DOUBLE')} AS val FROM k WHERE b IS NULL OR b - a <= 6 OR k * 1.5 = a")
def q_log_sampler(spark, sf):
    return models.regular(logs(spark, sf), ["well", "log"], "dah", ["val"], 1.5, max_hole=6.0).select("well", "log", "k", r("val").alias("val"))


@query("WITH p AS (SELECT l_suppkey AS well, CAST(l_quantity AS DOUBLE) AS z, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT well, z, CAST(sum(n) OVER (PARTITION BY well ORDER BY z) AS DOUBLE) / 8 AS t FROM p), i AS (SELECT *, lead(z) OVER w AS z2, lead(t) OVER w AS t2 FROM m WINDOW w AS (PARTITION BY well ORDER BY z)), q AS (SELECT DISTINCT s_suppkey AS well, k + 0.25::DOUBLE AS z FROM supplier, range(50) r(k)) SELECT q.well, q.z AS depth, round(i.t + (q.z - i.z) / (i.z2 - i.z) * (i.t2 - i.t), 6) AS twt FROM q LEFT JOIN i ON q.well = i.well AND q.z > i.z AND q.z < i.z2")
def q_well_time_depth(spark, sf):
    w = Window.partitionBy("well").orderBy("dah")
    p = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("well"), F.col("l_quantity").alias("dah")).count()
    model = p.select("well", "dah", (F.sum("count").over(w) / 8.0).alias("val"))
    at = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("well"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k")).select("well", (F.col("k") + 0.25).alias("at"))
    return earth.at_depth(model, at).select("well", F.col("at").alias("depth"), r("val").alias("twt"))


@query(f"WITH {E}, b AS (SELECT model, vp, sum(thickness) OVER (PARTITION BY model ORDER BY layer) AS base, thickness FROM m), c AS (SELECT model, vp, base - thickness AS top, base, unnest(range(CAST(floor((base - thickness) / 12) AS BIGINT), CAST(ceil(base / 12) AS BIGINT))) AS k FROM b) SELECT model, k, round(sum(vp * (least(base, (k + 1) * 12) - greatest(top, k * 12))) / sum(least(base, (k + 1) * 12) - greatest(top, k * 12)), 6) AS vel FROM c GROUP BY ALL")
def q_resample_velocity(spark, sf):
    tops = earth.layer_tops(_layers(spark, sf)).select("model", F.col("ztop").alias("top"), F.col("zbase").alias("base"), F.col("vp").alias("vel"))
    return models.resampled_velocity(tops, "model", 12.0).select("model", "k", r("vel").alias("vel"))


@query(f"WITH {T}, f AS (SELECT trace, z_idx, (z_idx + 1) / 10.0::DOUBLE AS t, 1500 + 20 * z_idx + val AS vrms FROM t), n AS (SELECT *, t - lag(t, 1, 0) OVER w AS dt, vrms * vrms * t - lag(vrms * vrms * t, 1, 0) OVER w AS e FROM f WINDOW w AS (PARTITION BY trace ORDER BY z_idx)) SELECT trace, z_idx, round(sum(CASE WHEN e >= 0 THEN sqrt(e / dt) * dt END) OVER (PARTITION BY trace ORDER BY z_idx) / t, 4) AS vavg FROM n")
def q_velocity_volume_conversion(spark, sf):
    f = trace_view(spark, sf).select(F.col("trace").alias("key"), "z_idx", ((F.col("z_idx") + 1) / 10.0).cast("double").alias("t"), (1500 + 20 * F.col("z_idx") + F.col("val")).alias("vrms"))
    w = Window.partitionBy("key").orderBy("t")
    rows = earth.dix(f).withColumn("dt", F.col("t") - F.lag("t", 1, 0.0).over(w))
    return rows.select(F.col("key").alias("trace"), "z_idx", r(F.sum(F.col("vint") * F.col("dt")).over(w) / F.col("t"), 4).alias("vavg"))


# ---- events, contours, statics


@query(f"WITH {T}, n AS (SELECT trace, z_idx AS z, val AS v, lag(val) OVER w AS a, lead(val) OVER w AS b FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)) SELECT trace, CASE WHEN v > a THEN 'peak' ELSE 'trough' END AS kind, round(z + 0.5 * (a - b) / (a - 2 * v + b), 6) AS at FROM n WHERE (v > a AND v >= b) OR (v < a AND v <= b) UNION ALL SELECT trace, 'zero', round(z - 1 + (50 - a) / (v - a), 6) FROM n WHERE (a < 50) <> (v < 50)")
def q_extremes_zeros(spark, sf):
    return models.events(trace_view(spark, sf), 50.0).select("trace", "kind", r("at").alias("at"))


@query(f"WITH {G} SELECT a.z, round(a.inl + (b.inl - a.inl) * (37.5 - a.val) / (b.val - a.val), 6) AS x, round(a.crl + (b.crl - a.crl) * (37.5 - a.val) / (b.val - a.val), 6) AS y FROM g a JOIN g b ON a.z = b.z AND ((b.inl = a.inl + 1 AND b.crl = a.crl) OR (b.inl = a.inl AND b.crl = a.crl + 1)) WHERE (a.val < 37.5) <> (b.val < 37.5)")
def q_isocontour(spark, sf):
    return models.contour(grid(spark, sf), 37.5, ["z"]).select("z", r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {T}, p AS (SELECT trace % 10 AS gather, z_idx, avg(val) AS pilot FROM t GROUP BY ALL), s AS (SELECT t.trace % 10 AS gather, t.trace, k AS shift, round(sum(val * pilot), 6) AS score FROM t, range(-3, 4) r(k), p WHERE p.gather = t.trace % 10 AND p.z_idx = t.z_idx + k GROUP BY ALL) SELECT gather, trace, CAST(shift AS INTEGER) AS shift FROM s QUALIFY row_number() OVER (PARTITION BY gather, trace ORDER BY score DESC, abs(shift), shift) = 1")
def q_ps_trim_statics(spark, sf):
    return models.trim_statics(trace_view(spark, sf).withColumn("gather", F.col("trace") % 10), 3)


# ---- plain text


@query(f"WITH {H} SELECT CAST(pos AS DOUBLE) * 25 AS x, CAST(hor = 'F' AS BIGINT) AS part, CASE WHEN z < 150 THEN z / 1000 END AS z FROM h")
def q_ascii_table(spark, sf):
    path = scratch(spark, "ascii")
    z = F.when(F.col("z") < 150, F.col("z").cast("string")).otherwise("1e30")
    line = F.concat_ws("  ", (F.col("pos") * 25).cast("string"), F.lit("note"), (F.col("hor") == "F").cast("int").cast("string"), z)
    horizons(spark, sf).select(line.alias("value")).union(spark.sql("SELECT '# x note part z'")).write.text(path)
    fields = {"x": (1, "double", 1.0), "part": (3, "long", 1.0), "z": (4, "double", 0.001)}
    return text.read_columns(spark, path, fields).select("x", "part", F.round("z", 9).alias("z"))
