"""Queries of volumes, gathers, wells and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import volumes
from terrane.plans.registry import query, r
from terrane.plans.views import G, T, grid, load
from terrane.plans.views import traces as trace_view

_EDGE = ", ".join(f"CASE WHEN {f}(z_idx, {k}) OVER w IS NULL THEN {e}(val) OVER (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE {f}(val, {k}) OVER w END AS {n}" for f, k, e, n in [("lag", 2, "first", "a"), ("lag", 1, "first", "b"), ("lead", 1, "last", "d"), ("lead", 2, "last", "e")])


@query(f"WITH {T}, k AS (SELECT trace, z_idx, val, {_EDGE} FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)) SELECT trace, z_idx, round((a + b + val + d + e) / 5, 5) AS average, list_sort([a, b, val, d, e])[3] AS median FROM k")
def q_vp_statistics(spark, sf):
    return volumes.clamped_statistics(trace_view(spark, sf), 2).select("trace", "z_idx", r("average", 5).alias("average"), "median")


@query(f"WITH {G} SELECT inl, crl, z, CAST(CASE WHEN val < 30 THEN 0 WHEN val >= 30 THEN 1 END AS DOUBLE) AS val FROM g")
def q_vp_threshold(spark, sf):
    return volumes.threshold(grid(spark, sf), 30.0, 0.0, 1.0)


_SURFACES = "s AS (SELECT l_suppkey AS inl, CAST(year(min(l_shipdate)) + 1 AS BIGINT) AS top_z, CAST(year(max(l_shipdate)) - 1 AS BIGINT) AS base_z FROM lineitem GROUP BY 1)"


@query(f"WITH {G}, {_SURFACES} SELECT g.inl, crl, z, round(CASE WHEN z BETWEEN top_z AND base_z THEN 2000 + (z - top_z) * 12.5 ELSE val END, 3) AS val FROM g LEFT JOIN s ON g.inl = s.inl")
def q_vp_horizon_filler(spark, sf):
    li = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("inl"))
    surfaces = li.agg((F.year(F.min("l_shipdate")) + 1).cast("long").alias("top_z"), (F.year(F.max("l_shipdate")) - 1).cast("long").alias("base_z"))
    return volumes.filled_between(grid(spark, sf), surfaces, 2000.0, 12.5).withColumn("val", r("val", 3))


@query(f"WITH {G} SELECT inl, crl, z, CASE WHEN least(5 - abs(inl - 5), 3 - abs(crl - 3)) >= 0 THEN 1.5 ELSE val END AS val FROM g")
def q_vp_body_filler(spark, sf):
    inside = volumes.body("intersection", 5 - F.abs(F.col("inl") - 5), 3 - F.abs(F.col("crl") - 3)) >= 0
    return grid(spark, sf).withColumn("val", volumes.in_body(inside, 1.5, None, keep_outside=True))


@query("WITH p AS (SELECT p_partkey, CAST(20 - abs(p_size - 20) AS DOUBLE) AS a, 1200 - p_retailprice AS b FROM part) SELECT p_partkey, round(greatest(a, b), 3) AS joint, round(least(a, b), 3) AS common, round(least(a, -b), 3) AS less FROM p")
def q_body_operators(spark, sf):
    a, b = (20 - F.abs(F.col("p_size") - 20)).cast("double"), 1200 - F.col("p_retailprice")
    return load(spark, sf, "part").select("p_partkey", *[r(volumes.body(o, a, b), 3).alias(n) for o, n in (("union", "joint"), ("intersection", "common"), ("minus", "less"))])


@query()
def q_voxel_connectivity(spark, sf):
    return volumes.voxel_components(grid(spark, sf), 20.0, 40.0, 3)


@query(f"WITH {G} SELECT CAST(k AS INTEGER) AS lag, count(*) AS n, round(avg((b.val - a.val) * (b.val - a.val)) / 2, 3) AS gamma FROM g a CROSS JOIN range(1, 5) x(k) JOIN g b ON b.inl = a.inl + k AND b.crl = a.crl AND b.z = a.z GROUP BY 1")
def q_variogram_horizontal(spark, sf):
    return volumes.semivariance(grid(spark, sf), "inl", 4).withColumn("gamma", r("gamma", 3))


@query("SELECT p_partkey, round(8 * (1 - exp(-3 * p_size / 30.0)) + 2, 6) AS exponential, round(8 * (1 - exp(-3 * power(p_size / 30.0, 2))) + 2, 6) AS gaussian, round(CASE WHEN p_size >= 30 THEN 10 ELSE 8 * (1.5 * p_size / 30.0 - 0.5 * power(p_size / 30.0, 3)) + 2 END, 6) AS spherical FROM part")
def q_variogram_model(spark, sf):
    return load(spark, sf, "part").select("p_partkey", *[r(volumes.variogram(m, F.col("p_size"), 30.0, 10.0, 2.0)).alias(m) for m in ("exponential", "gaussian", "spherical")])


@query("""WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_discount, l_discount) AS yy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz FROM lineitem GROUP BY 1),
p AS (SELECT *, CASE WHEN abs(xx * yy - xy * xy) > 1e-9 * xx * yy THEN xx * yy - xy * xy END AS det FROM m), f AS (SELECT *, (xz * yy - yz * xy) / det AS ax, (yz * xx - xz * xy) / det AS ay FROM p)
SELECT l_suppkey, round(mz - ax * mx - ay * my, 3) AS a0, round(ax, 3) AS ax, round(ay, 2) AS ay FROM f""")
def q_lin_stats_3d(spark, sf):
    got = volumes.plane(load(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    return got.select("l_suppkey", r("a0", 3).alias("a0"), r("ax", 3).alias("ax"), r("ay", 2).alias("ay"))


@query()
def q_pca(spark, sf):
    return volumes.principal_components(load(spark, sf, "embeddings"), "embedding")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * least(1, greatest(0, (l_linenumber - l_quantity / 10) / 1.5)), 4) AS outer_muted, round(l_extendedprice * least(1, greatest(0, (l_quantity / 10 - l_linenumber) / 1.5)), 4) AS tail_muted FROM lineitem")
def q_ps_mute(spark, sf):
    z, mute, val = F.col("l_linenumber"), F.col("l_quantity") / 10, F.col("l_extendedprice")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(volumes.muted(val, z, mute, 1.5), 4).alias("outer_muted"), r(volumes.muted(val, z, mute, 1.5, tail=True), 4).alias("tail_muted"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, degrees(atan2(l_quantity / 2, l_linenumber * 10)) AS angle FROM lineitem) SELECT l_orderkey, l_linenumber, round(angle, 5) AS angle, CASE WHEN angle > 30 THEN 0 ELSE v END AS muted FROM a")
def q_ps_angle_mute(spark, sf):
    angle = volumes.incidence_angle(F.col("l_quantity"), F.col("l_linenumber") * 10)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(angle, 5).alias("angle"), F.when(angle > 30, 0.0).otherwise(F.col("l_extendedprice")).alias("muted"))


@query("WITH s AS (SELECT l_suppkey, l_linenumber, l_orderkey, l_extendedprice AS v, sqrt(avg(l_extendedprice * l_extendedprice) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_extendedprice ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS l FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN l > 0 THEN v / l ELSE 0 END, 6) AS agc FROM s")
def q_ps_agc(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_orderkey").alias("z"), F.col("l_extendedprice").alias("val"))
    return volumes.gather_agc(rows, ["l_suppkey", "l_linenumber"], -3, 3).select(F.col("z").alias("l_orderkey"), "l_linenumber", r("agc").alias("agc"))


@query(f"""WITH {T}, s AS (SELECT trace AS well, z_idx * 30.0 AS md, radians((z_idx * 7) % 60) AS i, radians((z_idx * 37) % 360) AS a FROM t),
k AS (SELECT *, lag(i) OVER w AS i0, lag(a) OVER w AS a0 FROM s WINDOW w AS (PARTITION BY well ORDER BY md)),
b AS (SELECT *, acos(least(1, greatest(-1, cos(i - i0) - sin(i0) * sin(i) * (1 - cos(a - a0))))) AS bend FROM k),
f AS (SELECT *, 15 * CASE WHEN bend < 1e-6 THEN 1 ELSE 2 / bend * tan(bend / 2) END AS h FROM b)
SELECT well, CAST(md AS DOUBLE) AS md, round(sum(coalesce(h * (sin(i0) * sin(a0) + sin(i) * sin(a)), 0)) OVER w, 4) AS x, round(sum(coalesce(h * (sin(i0) * cos(a0) + sin(i) * cos(a)), 0)) OVER w, 4) AS y, round(sum(coalesce(h * (cos(i0) + cos(i)), 0)) OVER w, 4) AS tvd
FROM f WINDOW w AS (PARTITION BY well ORDER BY md)""")
def q_directional_survey(spark, sf):
    z = F.col("z_idx")
    rows = trace_view(spark, sf).select(F.col("trace").alias("well"), (z * 30.0).alias("md"), (z * 7 % 60).alias("incl"), (z * 37 % 360).alias("azi"))
    return volumes.minimum_curvature(rows).select("well", "md", *[r(c, 4).alias(c) for c in ("x", "y", "tvd")])


@query("WITH m AS (SELECT o_custkey AS well, o_orderkey AS marker, o_totalprice AS dah FROM orders) SELECT well, marker, dah AS top, lead(dah) OVER w AS base, round(lead(dah) OVER w - dah, 2) AS thickness FROM m WINDOW w AS (PARTITION BY well ORDER BY dah, marker)")
def q_marker_zones(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("well"), F.col("o_orderkey").alias("marker"), F.col("o_totalprice").alias("dah"))
    return volumes.zones(rows).withColumn("thickness", r("thickness", 2))


@query("WITH g AS (SELECT l_suppkey, sum(l_quantity) AS thickness, sum(l_quantity * (2 + l_discount)) AS mass, sum(l_quantity / ((2 + l_discount) * power(2000 + l_extendedprice / 50, 2))) AS soft FROM lineitem GROUP BY 1) SELECT l_suppkey, thickness, round(mass / thickness, 6) AS den, round(sqrt(thickness / soft / (mass / thickness)), 4) AS vel FROM g")
def q_backus_average(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("thickness"), (2 + F.col("l_discount")).alias("den"), (2000 + F.col("l_extendedprice") / 50).alias("vel"))
    return volumes.backus(rows, "l_suppkey").select("l_suppkey", "thickness", r("den").alias("den"), r("vel", 4).alias("vel"))


@query("WITH p AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer) SELECT c_custkey, round(((x - 100) * 24 - (y - 200) * -7) / 625, 5) AS inl, round(((y - 200) * 24 - (x - 100) * 7) / 625, 5) AS crl FROM p")
def q_bin_coordinates(spark, sf):
    i, c = volumes.affine(F.col("c_acctbal"), F.col("c_nationkey") * 100.0, (100.0, 200.0), (24.0, 7.0), (-7.0, 24.0))
    return load(spark, sf, "customer").select("c_custkey", r(i, 5).alias("inl"), r(c, 5).alias("crl"))


@query("""WITH p AS (SELECT s_suppkey, s_acctbal / 200 AS lat, s_nationkey * 5.0 AS lon FROM supplier), a AS (SELECT *, power(sin(radians(lat - 52) / 2), 2) + cos(radians(52)) * cos(radians(lat)) * power(sin(radians(lon - 4.5) / 2), 2) AS a FROM p)
SELECT s_suppkey, round(2 * 6371000 * asin(sqrt(least(1, a))), 2) AS metres, round((degrees(atan2(lon - 4.5, lat - 52)) + 360) % 360, 6) AS azimuth FROM a""")
def q_geometry(spark, sf):
    lat, lon = F.col("s_acctbal") / 200, F.col("s_nationkey") * 5.0
    return load(spark, sf, "supplier").select("s_suppkey", r(volumes.great_circle(F.lit(52.0), F.lit(4.5), lat, lon), 2).alias("metres"), r(volumes.azimuth(lon - 4.5, lat - 52)).alias("azimuth"))


@query("WITH k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS rank FROM embeddings WHERE label IS NOT NULL) SELECT vec_id, label FROM k WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label))")
def q_nla_balance(spark, sf):
    return volumes.balanced(load(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def q_json_get(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, string_split(p_type, ' ')[2] AS second, len(string_split(p_type, ' ')) AS n, replace(p_type, ' ', '`') AS joined, md5(p_name) AS hash, TRY_CAST(right(p_brand, 2) AS DOUBLE) AS number FROM part")
def q_separated_strings(spark, sf):
    parts = F.split("p_type", " ")
    return load(spark, sf, "part").select("p_partkey", F.get(parts, F.lit(1)).alias("second"), F.size(parts).cast("long").alias("n"), F.concat_ws("`", parts).alias("joined"), F.md5("p_name").alias("hash"), F.expr("try_cast(right(p_brand, 2) AS double)").alias("number"))


@query("WITH p AS (SELECT p_partkey, p_retailprice AS v, p_size % 4 AS u FROM part) SELECT p_partkey, round(v * CASE u WHEN 0 THEN 0.3048 WHEN 1 THEN 1 WHEN 2 THEN 1000 ELSE 0.0254 END, 6) AS metres FROM p")
def q_unit_conversion(spark, sf):
    #: Length units in metres. Fixed values.
    units = {0: 0.3048, 1: 1.0, 2: 1000.0, 3: 0.0254}
    factor = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return load(spark, sf, "part").select("p_partkey", r(F.col("p_retailprice") * factor[F.col("p_size") % 4]).alias("metres"))


@query("WITH b AS (SELECT o_orderstatus AS set_name, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1) SELECT min(lo) AS union_lo, max(hi) AS union_hi, max(lo) AS common_lo, min(hi) AS common_hi FROM b")
def q_sampling_boxes(spark, sf):
    boxes = load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))
    return boxes.agg(F.min("lo").alias("union_lo"), F.max("hi").alias("union_hi"), F.max("lo").alias("common_lo"), F.min("hi").alias("common_hi"))


@query("WITH RECURSIVE u AS (SELECT n_nationkey AS code, CAST(n_name AS VARCHAR) AS path, 1 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, u.path || '.' || n.n_name, u.depth + 1 FROM nation n JOIN u ON (n.n_nationkey - 1) // 3 = u.code AND n.n_nationkey > 0) SELECT CAST(code AS BIGINT) AS code, path, CAST(depth AS INTEGER) AS depth FROM u")
def q_unit_tree(spark, sf):
    return spark.sql("WITH RECURSIVE u AS (SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS path, 1 AS depth FROM {units} WHERE n_nationkey = 0 UNION ALL SELECT CAST(n.n_nationkey AS BIGINT), concat(u.path, '.', n.n_name), u.depth + 1 FROM {units} n JOIN u ON (n.n_nationkey - 1) DIV 3 = u.code AND n.n_nationkey > 0) SELECT code, path, depth FROM u", units=load(spark, sf, "nation"))


@query("WITH t AS (SELECT o_custkey, o_orderdate AS d, o_totalprice AS v FROM orders) SELECT o_custkey, count(*) AS n, round(sum((v + p) / 2 * datediff('day', q, d)), 3) AS volume FROM (SELECT *, lag(v) OVER w AS p, lag(d) OVER w AS q FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY d, v)) GROUP BY 1")
def q_polygon_volume(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_totalprice")
    v, d = F.col("o_totalprice"), F.col("o_orderdate")
    strip = (v + F.lag(v).over(w)) / 2 * F.datediff(d, F.lag(d).over(w))
    return load(spark, sf, "orders").select("o_custkey", strip.alias("strip")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("strip"), 3).alias("volume"))
