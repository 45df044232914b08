"""Queries of positions, point tables, conditions, wells, layers and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.operators import earth, points, positions
from terrane.plans.registry import query, r
from terrane.plans.views import G, H, T, grid, horizons, load
from terrane.plans.views import traces as trace_view

#: A slanted polygon for selections, and the same as edges.
CORNERS = [(3.0, 1.5), (41.0, 2.5), (46.0, 6.5), (20.0, 4.5), (8.0, 7.5)]
EDGES = "e(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(CORNERS, CORNERS[1:] + CORNERS[:1])) + ")"
INSIDE = "(SELECT count(*) FROM e WHERE (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1) % 2 = 1"


@query("WITH b AS (SELECT min(l_suppkey) AS i0, max(l_suppkey) AS i1, min(l_linenumber) AS c0, max(l_linenumber) AS c1 FROM lineitem) SELECT i AS inl, c AS crl, z FROM (SELECT unnest(generate_series(i0, i1, 3)) AS i FROM b), (SELECT unnest(generate_series(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT), 2)) AS c FROM b), range(0, 101, 50) d(z)")
def q_pos_provider_range_3d(spark, sf):
    """Every third and second bin of the area that the lines span."""
    i0, i1, c0, c1 = load(spark, sf, "lineitem").agg(F.min("l_suppkey"), F.max("l_suppkey"), F.min("l_linenumber"), F.max("l_linenumber")).first()
    return positions.box(spark, inl=(i0, i1, 3), crl=(c0, c1, 2), z=(0, 100, 50))


@query("SELECT s_suppkey AS line, unnest(range(1, CAST(s_nationkey AS BIGINT) + 1, 2)) AS trc FROM supplier")
def q_pos_provider_range_2d(spark, sf):
    lines = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("line"), "s_nationkey")
    return positions.along_lines(lines, F.lit(1), F.col("s_nationkey"), 2).select("line", "trc")


@query(f"WITH {EDGES}, g AS (SELECT DISTINCT l_suppkey AS inl, CAST(l_linenumber AS BIGINT) AS crl FROM lineitem) SELECT inl, crl FROM g WHERE {INSIDE.format(x='inl', y='crl')}")
def q_pos_provider_polygon(spark, sf):
    """The bins that have lines, within a polygon."""
    bins = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("inl"), F.col("l_linenumber").cast("long").alias("crl")).distinct()
    return bins.where(points.in_polygon(F.col("inl").cast("double"), F.col("crl").cast("double"), CORNERS))


@query("SELECT DISTINCT l_suppkey AS inl, l_linenumber AS crl, l_quantity AS z FROM lineitem WHERE l_extendedprice IS NOT NULL")
def q_pos_provider_table(spark, sf):
    return load(spark, sf, "lineitem").where("l_extendedprice IS NOT NULL").select(F.col("l_suppkey").alias("inl"), F.col("l_linenumber").alias("crl"), F.col("l_quantity").alias("z")).distinct()


@query(f"WITH {H}, b AS (SELECT a.pos, least(a.z, b.z) AS low, greatest(a.z, b.z) AS high FROM h a JOIN h b USING (pos) WHERE a.hor = 'F' AND b.hor = 'O') SELECT pos, round(low + k * 2.5, 6) AS z FROM (SELECT pos, low, unnest(range(0, CAST(floor((high - low) / 2.5) AS BIGINT) + 1)) AS k FROM b)")
def q_pos_provider_surface(spark, sf):
    h = horizons(spark, sf)
    of = lambda k: h.where(F.col("hor") == k).select("pos", "z")
    return positions.between_surfaces(of("F"), of("O"), ["pos"], 2.5).select("pos", r("z").alias("z"))


@query(f"WITH {G} SELECT inl, crl, z FROM g WHERE val >= 37.5")
def q_pos_provider_body(spark, sf):
    return grid(spark, sf).where("val >= 37.5").select("inl", "crl", "z")


@query(f"WITH {H}, {EDGES}, b AS (SELECT a.pos, least(a.z, b.z) AS low, greatest(a.z, b.z) AS high FROM h a JOIN h b USING (pos) WHERE a.hor = 'F' AND b.hor = 'O'), c AS (SELECT c_custkey AS id, c_custkey % 200 AS pos, (c_acctbal + 1000) / 50 AS z FROM customer) SELECT c.id FROM c JOIN b USING (pos) WHERE c.z BETWEEN b.low AND b.high AND {INSIDE.format(x='(c.pos / 4.0)', y='(c.id % 9)')}")
def q_pos_provider_region(spark, sf):
    h = horizons(spark, sf)
    both = h.where("hor = 'F'").select("pos", F.col("z").alias("a")).join(h.where("hor = 'O'").select("pos", F.col("z").alias("b")), "pos")
    at = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).alias("pos"), ((F.col("c_acctbal") + 1000) / 50).alias("z"))
    tests = [F.col("z").between(F.least("a", "b"), F.greatest("a", "b")), points.in_polygon(F.col("pos") / 4.0, (F.col("id") % 9).cast("double"), CORNERS)]
    return at.join(both, "pos").where(positions.all_pass(tests)).select("id")


@query("SELECT DISTINCT s_suppkey + i AS inl, CAST(s_nationkey + c AS BIGINT) AS crl FROM supplier, range(-2, 3) a(i), range(-1, 2) b(c)")
def q_pos_provider_well(spark, sf):
    return positions.around(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("inl"), F.col("s_nationkey").cast("long").alias("crl")), 2, 1)


@query(f"WITH {G} SELECT DISTINCT inl, crl FROM g")
def q_pos_provider_seis(spark, sf):
    return grid(spark, sf).select("inl", "crl").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey BETWEEN 2 AND 60 AND (l_suppkey - 2) % 2 = 0 AND l_quantity >= 10 AND CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.25")
def q_pos_filter_set(spark, sf):
    tests = [points.in_range("l_suppkey", 2, 60, 2), F.col("l_quantity") >= 10, positions.passes(F.col("l_orderkey"), 25)]
    return load(spark, sf, "lineitem").where(positions.all_pass(tests)).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3")
def q_pos_filter_random(spark, sf):
    return load(spark, sf, "events").where(positions.passes(F.col("event_id"), 0.3)).select("event_id")


@query("SELECT event_id, round(CAST('0x' || substr(md5('seed' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0, 9) AS u FROM events")
def q_random_gen(spark, sf):
    return load(spark, sf, "events").select("event_id", r(positions.fraction(F.col("event_id"), "seed"), 9).alias("u"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE (k - 1) % 3 = 0")
def q_pos_filter_subsample(spark, sf):
    return positions.every_nth(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT i AS inl, c AS crl, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = i AND l_linenumber = c AND l_quantity > 45) AS accepted FROM range(1, 30) a(i), range(1, 8) b(c)")
def q_dps_extract_positions(spark, sf):
    all_ = positions.box(spark, inl=(1, 29, 1), crl=(1, 7, 1))
    given = load(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("inl"), F.col("l_linenumber").cast("long").alias("crl"))
    yes, no = (positions.kept(all_, given, ["inl", "crl"], a).withColumn("accepted", F.lit(a)) for a in (True, False))
    return yes.unionByName(no)


@query("SELECT o_orderkey, CAST(g AS INTEGER) AS grp, g < 0 AS selected FROM (SELECT o_orderkey, (o_custkey % 4) * CASE WHEN o_totalprice > 200000 THEN -1 ELSE 1 END AS g FROM orders) WHERE g <> 0")
def q_dps_groups(spark, sf):
    g = (F.col("o_custkey") % 4) * F.when(F.col("o_totalprice") > 200000, -1).otherwise(1)
    return load(spark, sf, "orders").select("o_orderkey", g.cast("int").alias("grp")).where("grp != 0").withColumn("selected", F.col("grp") < 0)


@query("WITH a AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_suppkey AS bin, floor(l_extendedprice / 5000) / 10 + (l_linenumber % 4) * 4e-7 AS z FROM lineitem), b AS (SELECT o_custkey AS bin, floor(o_totalprice / 40000) / 10 AS z, o_orderkey FROM orders) SELECT l_orderkey, l_linenumber, coalesce(min(o_orderkey), -1) AS found FROM a LEFT JOIN b ON a.bin = b.bin AND abs(a.z - b.z) < 1e-6 GROUP BY a.id, 1, 2")
def q_dps_find_exact(spark, sf):
    """Lines at depths of tenths, some a little off, and the order at the same place: 8e-7 off is found, 1.2e-6 is not."""
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("bin"), (F.floor(F.col("o_totalprice") / 40000) / 10).alias("z"), "o_orderkey")
    at = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("bin"), (F.floor(F.col("l_extendedprice") / 5000) / 10 + (F.col("l_linenumber") % 4) * F.lit(4e-7)).alias("z"))
    return positions.find_exact(at, rows, ["bin"], "z", "o_orderkey").select("l_orderkey", "l_linenumber", F.coalesce("o_orderkey", F.lit(-1)).alias("found"))


@query("SELECT p_partkey, p_retailprice AS price, round(p_retailprice * 0.5, 4) AS half FROM part")
def q_dps_columns(spark, sf):
    p = load(spark, sf, "part").withColumnRenamed("p_retailprice", "price").withColumn("half", r(F.col("price") * 0.5, 4))
    return p.drop("p_name", "p_brand", "p_type", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 150 OFFSET 20")
def q_start_stop_rows(spark, sf):
    return load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey").orderBy("o_orderkey").offset(20).limit(150)


@query("SELECT c_custkey, c_name FROM customer WHERE ((c_acctbal >= 1000 AND c_acctbal < 4000) OR c_mktsegment = 'BUILDING') AND c_name IS NOT NULL AND c_name LIKE '%1%' AND c_nationkey <> 3")
def q_sql_conditions(spark, sf):
    c = positions.condition
    some = positions.all_pass([positions.all_pass([c("c_acctbal", ">=", 1000), c("c_acctbal", "<", 4000)]), c("c_mktsegment", "=", "BUILDING")], any_of=True)
    return load(spark, sf, "customer").where(positions.all_pass([some, c("c_name", "is not null"), c("c_name", "like", "%1%"), c("c_nationkey", "!=", 3)])).select("c_custkey", "c_name")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def q_sql_changes(spark, sf):
    s = load(spark, sf, "supplier")
    left = positions.kept(s, s.where("s_suppkey % 7 = 0"), ["s_suppkey"], accept=False)
    new = s.where("s_acctbal < 0").select((-F.col("s_suppkey")).alias("s_suppkey"), "s_acctbal")
    return positions.changed(left, "s_suppkey", {"s_acctbal": F.col("s_acctbal") + 100}, F.col("s_nationkey") < 5).select("s_suppkey", "s_acctbal").unionByName(new)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_well_filter_no_logs(spark, sf):
    wells = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return positions.kept(wells, load(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], accept=False)


@query("SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)")
def q_well_common_items(spark, sf):
    return positions.held_by_all(load(spark, sf, "events"), "user_id", "event_type")


@query("SELECT l_suppkey, max(CASE WHEN l_quantity BETWEEN 20 AND 22 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_quantity BETWEEN 20 AND 22 AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS n, max(CASE WHEN l_quantity BETWEEN 20 AND 22 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1")
def q_well_log_presence(spark, sf):
    return positions.presence(load(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], F.col("l_quantity").between(20, 22))


_FLAGS = "v AS (SELECT l_returnflag AS cube, l_suppkey AS inl, l_linenumber AS crl, max(l_extendedprice) AS val FROM lineitem GROUP BY ALL)"


def _cubes(spark, sf):
    v = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("cube"), F.col("l_suppkey").alias("inl"), F.col("l_linenumber").alias("crl")).agg(F.max("l_extendedprice").alias("val"))
    return {k: v.where(F.col("cube") == k).select("inl", "crl", "val") for k in "ANR"}


@query(f"WITH {_FLAGS} SELECT inl, crl, a.val AS a, n.val AS n, r.val AS r FROM (FROM v WHERE cube = 'A') a JOIN (FROM v WHERE cube = 'N') n USING (inl, crl) JOIN (FROM v WHERE cube = 'R') r USING (inl, crl)")
def q_input_alignment(spark, sf):
    return positions.aligned({k.lower(): v for k, v in _cubes(spark, sf).items()}, ["inl", "crl"], "val")


@query("SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def q_dps_merge_nomatch(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query(f"WITH {_FLAGS} SELECT inl, crl, CASE cube WHEN 'A' THEN 0 ELSE 1 END AS offset_no, val FROM v WHERE cube <> 'R'")
def q_prestack_merge(spark, sf):
    cubes = _cubes(spark, sf)
    return cubes["A"].withColumn("offset_no", F.lit(0)).unionByName(cubes["N"].withColumn("offset_no", F.lit(1)))


@query(f"WITH {_FLAGS} SELECT CASE cube WHEN 'N' THEN inl - 1 ELSE inl END AS line, crl AS trc, round(avg(val), 7) AS val FROM v WHERE cube IN ('A', 'N') GROUP BY 1, 2")
def q_line_merge_2d(spark, sf):
    cubes = _cubes(spark, sf)
    # each line of one survey with the next line of the other
    both = cubes["A"].unionByName(cubes["N"].withColumn("inl", F.col("inl") - 1))
    return both.groupBy(F.col("inl").alias("line"), F.col("crl").alias("trc")).agg(r(F.avg("val"), 7).alias("val"))


@query(f"WITH {H}, b AS (SELECT o.pos, o.z, f.z AS zt FROM (FROM h WHERE hor = 'O') o LEFT JOIN (FROM h WHERE hor = 'F') f USING (pos)) SELECT pos, CASE WHEN z < zt THEN zt ELSE z END AS z, coalesce(z < zt, false) AS moved FROM b")
def q_horizon_modify(spark, sf):
    h = horizons(spark, sf)
    top, base = (h.where(F.col("hor") == k).select("pos", "z") for k in "FO")
    stay = positions.untangled(top, base, ["pos"], remove=True)
    return positions.untangled(top, base, ["pos"], remove=False).join(stay.select("pos", F.lit(False).alias("s")), "pos", "left").select("pos", "z", F.coalesce("s", F.lit(True)).alias("moved"))


@query("WITH RECURSIVE p AS (SELECT DISTINCT p_size AS above, p_size + CAST(p_partkey % 3 AS INTEGER) + 1 AS below FROM part), c AS (SELECT above, below FROM p UNION SELECT c.above, p.below FROM c JOIN p ON c.below = p.above) SELECT above, below FROM c")
def q_horizon_relation_tree(spark, sf):
    pairs = load(spark, sf, "part").select(F.col("p_size").alias("above"), (F.col("p_size") + (F.col("p_partkey") % 3).cast("int") + 1).alias("below"))
    return positions.closed(pairs)


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice / 100 BETWEEN s_acctbal AND s_acctbal + 40")
def q_interval_join(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("x"))
    s = load(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 40).alias("high"))
    return positions.within(o, "x", s, "low", "high", 100.0).select("o_orderkey", "s_suppkey")


@query(f"WITH {G} SELECT c_custkey, g.val FROM customer LEFT JOIN g ON g.inl = c_custkey % 100 AND g.crl = 1 + c_nationkey % 7 AND g.z = 1992 + c_custkey % 7")
def q_table_attrib_extract(spark, sf):
    at = load(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("inl"), (1 + F.col("c_nationkey") % 7).cast("long").alias("crl"), (1992 + F.col("c_custkey") % 7).alias("z"))
    return at.join(grid(spark, sf), ["inl", "crl", "z"], "left").select("c_custkey", "val")


@query("SELECT l_suppkey AS inl, CAST(floor(l_quantity / 10) AS BIGINT) AS crl, round(avg(l_extendedprice), 7) AS val FROM lineitem GROUP BY ALL")
def q_volume_from_dps(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("inl"), F.floor(F.col("l_quantity") / 10).alias("crl")).agg(r(F.avg("l_extendedprice"), 7).alias("val"))


@query(f"WITH {G} SELECT n_nationkey AS line, g.crl AS trc, g.z, g.val FROM nation JOIN g ON g.inl = n_nationkey AND g.crl <= 1 + n_regionkey")
def q_cube_to_line(spark, sf):
    lines = load(spark, sf, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_nationkey").cast("long").alias("inl"), (1 + F.col("n_regionkey")).alias("last"))
    at = positions.along_lines(lines, F.lit(1), F.col("last"), 1, "crl")
    return at.join(grid(spark, sf), ["inl", "crl"]).select("line", F.col("crl").alias("trc"), "z", "val")


@query(f"WITH {G}, d AS (SELECT i AS trc, i * 0.75 AS d FROM range(0, 30) x(i)), p AS (SELECT trc, CASE WHEN d >= 15 THEN 10 ELSE 1 + 0.6 * d END AS x, CASE WHEN d >= 15 THEN 13 - (d - 15) ELSE 1 + 0.8 * d END AS y FROM d) SELECT trc, g.z, g.val FROM p JOIN g ON g.inl = round(x) AND g.crl = round(y)")
def q_random_line(spark, sf):
    at = positions.polyline(spark, [(1.0, 1.0), (10.0, 13.0), (10.0, 6.0)], 0.75)
    return at.join(grid(spark, sf), ["inl", "crl"]).select("trc", "z", "val")


_LAYERS = "y AS (SELECT l_orderkey AS model, l_linenumber AS layer, max(l_returnflag) AS unit, max(l_linestatus) AS lith, sum(l_quantity) AS th, sqrt(max(l_extendedprice)) AS v FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(th) OVER (PARTITION BY model ORDER BY layer) AS base FROM y)"


def _layers(spark, sf):
    of = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("layer"))
    return of.agg(F.max("l_returnflag").alias("unit"), F.max("l_linestatus").alias("lith"), F.sum("l_quantity").alias("thickness"), F.sqrt(F.max("l_extendedprice")).alias("v"))


@query(f"WITH {_LAYERS} SELECT model, round(sum(th * v) / sum(th), 6) AS mean, round(sum(th) / sum(th / v), 6) AS velocity, coalesce(sum(th), 0) AS thickness, count(th) AS n FROM (SELECT model, CASE WHEN unit IN ('A', 'R') AND lith = 'F' THEN th END AS th, v FROM y) GROUP BY model")
def q_layer_attrib_global(spark, sf):
    use = F.col("unit").isin("A", "R") & (F.col("lith") == "F")
    th = F.when(use, F.col("thickness"))
    return _layers(spark, sf).groupBy("model").agg(r(positions.layer_mean(F.col("v"), th), 6).alias("mean"), r(positions.layer_mean(F.col("v"), th, slowness=True), 6).alias("velocity"), F.coalesce(F.sum(th), F.lit(0.0)).alias("thickness"), F.count(th).alias("n"))


@query(f"WITH {_LAYERS}, c AS (SELECT model, v, greatest(0, least(base, 60) - greatest(base - th, 25)) AS w FROM t) SELECT model, round(sum(w * v) FILTER (w >= 1e-5) / sum(w) FILTER (w >= 1e-5), 6) AS mean, round(sum(w), 6) AS inside FROM c GROUP BY model")
def q_layer_attrib_local(spark, sf):
    tops = earth.layer_tops(_layers(spark, sf))
    w = positions.in_gate(F.col("ztop"), F.col("zbase"), F.lit(25.0), F.lit(60.0))
    return tops.withColumn("w", w).groupBy("model").agg(r(positions.layer_mean(F.col("v"), F.col("w")), 6).alias("mean"), r(F.sum("w")).alias("inside"))


@query("SELECT p_partkey, round(power(p_retailprice, 1.5), 4) AS pow, round(ln(p_retailprice) / ln(2), 6) AS log, round(power(1.05, p_size), 6) AS exp FROM part")
def q_layer_attrib_transform(spark, sf):
    v = F.col("p_retailprice")
    return load(spark, sf, "part").select("p_partkey", r(positions.transformed("pow", v, 1.5), 4).alias("pow"), r(positions.transformed("log", v, 2.0)).alias("log"), r(positions.transformed("exp", F.col("p_size"), 1.05)).alias("exp"))


@query("WITH s AS (SELECT user_id, CAST(floor(value / 10) AS BIGINT) - lag(CAST(floor(value / 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id AS line, count(*) AS n, count(*) FILTER (d = 0) AS repeats, count(*) FILTER (d > 0) AS rises, count(*) FILTER (d < 0) AS falls FROM s GROUP BY 1")
def q_duplicates_policy(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("line"), F.floor(F.col("value") / 10).alias("crl"), "ts", "event_id")
    return positions.ordering(e, "line", "crl", ["ts", "event_id"])


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT CAST(l_quantity AS INTEGER)) AS classes FROM lineitem GROUP BY 1")
def q_count_distinct(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.col("l_quantity").cast("int")).alias("classes"))


@query(f"WITH {G} SELECT z, count(*) * 25.0 * 12.5 * 4.0 AS volume FROM g WHERE val >= 37.5 GROUP BY z")
def q_body_volume(spark, sf):
    return grid(spark, sf).where("val >= 37.5").groupBy("z").agg((F.count(F.lit(1)) * 25.0 * 12.5 * 4.0).alias("volume"))


@query(f"WITH {T} SELECT trace, z_idx, round(sum(CASE WHEN val <= 90 THEN val END) OVER (PARTITION BY trace ORDER BY z_idx), 5) AS total FROM t")
def q_cumulative_integral(spark, sf):
    rows = trace_view(spark, sf).select("trace", "z_idx", F.when(F.col("val") <= 90, F.col("val")).alias("val"))
    return positions.running_total(rows, "trace", "z_idx", "val", 16).select("trace", "z_idx", r("total", 5).alias("total"))


@query(f"WITH {T} SELECT trace, z_idx, round(val * CASE WHEN z_idx BETWEEN 2 AND 8 THEN 1 + (z_idx - 2) / 6.0 WHEN z_idx BETWEEN 8 AND 20 THEN 2 - (z_idx - 8) / 12.0 * 1.5 ELSE 1 END, 6) AS val FROM t")
def q_scaling_gain(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", r(F.col("val") * positions.gained(F.col("z_idx"), [2, 8, 20], [1.0, 2.0, 0.5])).alias("val"))


@query("WITH o AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS u, sum(l_quantity) OVER (PARTITION BY l_suppkey) / 2 AS half FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)) SELECT l_suppkey, max(v) FILTER (k = n // 2) AS median, min(v) FILTER (u >= half) AS balance FROM o GROUP BY 1")
def q_stat_weighted_median(spark, sf):
    return positions.weighted_median(load(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_trace_buffer_sort(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_custkey"), "o_orderkey")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def q_iso_time(spark, sf):
    return load(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.hour("ts").alias("hour"))


@query("WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, list_max(a) AS most, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS norm, round(a[1] - list_avg(a), 6) AS unbiased, CAST(len(list_filter(a, lambda x, i: i % 2 = 1)) AS BIGINT) AS half FROM a")
def q_array_functions(spark, sf):
    a = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("a"))
    total = lambda f: F.aggregate("a", F.lit(0.0), lambda s, x: s + f(x))
    half = F.filter("a", lambda x, i: i % 2 == 0)
    return a.select("l_orderkey", F.array_max("a").alias("most"), r(F.sqrt(total(lambda x: x * x))).alias("norm"), r(F.col("a")[0] - total(lambda x: x) / F.size("a")).alias("unbiased"), F.size(half).cast("long").alias("half"))


@query("SELECT p_partkey, regexp_extract(p_brand, '^Brand#(.*)$', 1) AS number, regexp_extract(p_type, '^(.*) (.*)$', 2) AS last FROM part")
def q_macro_captures(spark, sf):
    return load(spark, sf, "part").select("p_partkey", positions.captures(F.col("p_brand"), "Brand#*", 1).alias("number"), positions.captures(F.col("p_type"), "* *", -1).alias("last"))


@query("SELECT s_suppkey, CAST(trunc(s_acctbal / 7) AS BIGINT) AS quotient, round(s_acctbal - trunc(s_acctbal / 7) * 7, 6) AS rest, CASE WHEN s_nationkey = 0 THEN NULL ELSE round(s_acctbal / s_nationkey, 6) END AS share, 2 ** (3 ** 2) AS towers FROM supplier")
def q_macro_operators(spark, sf):
    a = F.col("s_acctbal")
    whole = F.when(a < 0, F.ceil(a / 7)).otherwise(F.floor(a / 7))
    return load(spark, sf, "supplier").select("s_suppkey", whole.alias("quotient"), r(a - whole * 7).alias("rest"), r(F.try_divide(a, F.col("s_nationkey"))).alias("share"), F.pow(F.lit(2.0), F.pow(F.lit(3.0), F.lit(2.0))).alias("towers"))


@query(f"WITH {T} SELECT trace, z_idx, val AS sample, val AS relief FROM t")
def q_sample_value(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", F.col("val").alias("sample"), F.col("val").alias("relief"))


@query("SELECT o_custkey, round(avg(o_totalprice), 7) AS average, round(sqrt(avg(o_totalprice * o_totalprice)), 6) AS rms, round(sqrt(coalesce(var_samp(o_totalprice), 0)), 2) AS stddev FROM orders GROUP BY 1")
def q_stat_by_name(spark, sf):
    named = {"average": F.avg, "rms": stats.rms, "stddev": stats.stddev}
    return load(spark, sf, "orders").groupBy("o_custkey").agg(*[r(f(F.col("o_totalprice")), {"average": 7, "rms": 6, "stddev": 2}[n]).alias(n) for n, f in named.items()])


@query(f"WITH {T} SELECT trace, z_idx, round(val * 2 + 1, 6) AS scaled, round(val * val, 6) AS squared FROM t")
def q_tutorial(spark, sf):
    v = F.col("val")
    return trace_view(spark, sf).select("trace", "z_idx", r(v * 2 + 1).alias("scaled"), r(v * v).alias("squared"))


@query(f"WITH {_FLAGS} SELECT inl, crl, coalesce(r.val, a.val) AS val FROM (FROM v WHERE cube = 'A') a FULL JOIN (FROM v WHERE cube = 'R') r USING (inl, crl)")
def q_vp_volume_reader(spark, sf):
    cubes = _cubes(spark, sf)
    return points.first_of([cubes["R"], cubes["A"]], ["inl", "crl"])


@query(f"WITH {G}, s AS (SELECT inl, crl, min(z) AS zs FROM g WHERE val > 36 GROUP BY ALL) SELECT g.inl, g.crl, g.z, CASE WHEN g.z >= zs THEN 1500 + 0.5 * (g.z - zs) ELSE val END AS val FROM g LEFT JOIN s USING (inl, crl)")
def q_vp_surface_filler(spark, sf):
    g = grid(spark, sf)
    surface = g.where("val > 36").groupBy("inl", "crl").agg(F.min("z").alias("zs"))
    below = F.col("z") >= F.col("zs")
    return g.join(surface, ["inl", "crl"], "left").select("inl", "crl", "z", F.when(below, 1500 + 0.5 * (F.col("z") - F.col("zs"))).otherwise(F.col("val")).alias("val"))


@query(f"WITH {T}, {H}, f AS (SELECT pos, z FROM h WHERE hor = 'F') SELECT trace, z_idx, round(z_idx - f.z / 20, 6) AS flat, f.z AS horizon FROM t LEFT JOIN f ON f.pos = trace % 200")
def q_horizon_flattening(spark, sf):
    f = horizons(spark, sf).where("hor = 'F'").select("pos", F.col("z").alias("horizon"))
    rows = trace_view(spark, sf).withColumn("pos", F.col("trace") % 200).join(f, "pos", "left")
    return rows.select("trace", "z_idx", r(F.col("z_idx") - F.col("horizon") / 20).alias("flat"), "horizon")


@query(f"WITH {H}, f AS (SELECT pos, z FROM h WHERE hor = 'F'), n AS (SELECT a.pos, avg(b.z) AS smooth, quantile_disc(b.z, 0.5) AS median, count(*) AS n FROM f a JOIN f b ON abs(a.pos - b.pos) <= 2 GROUP BY 1) SELECT f.pos, round(smooth, 5) AS smooth, median, round(f.z + 0.1 * n, 5) AS shifted FROM f JOIN n USING (pos)")
def q_horizon_filters(spark, sf):
    f = horizons(spark, sf).where("hor = 'F'").select("pos", "z")
    near = f.withColumn("pos", F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2))).groupBy("pos").agg(F.avg("z").alias("smooth"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY z)").alias("median"), F.count(F.lit(1)).alias("n"))
    return f.join(near, "pos").select("pos", r("smooth", 5).alias("smooth"), "median", r(F.col("z") + 0.1 * F.col("n"), 5).alias("shifted"))


@query(f"WITH {T}, v AS (SELECT trace, z_idx, CASE WHEN trace % 3 = 0 THEN 0 ELSE val END AS val FROM t) SELECT trace, z_idx, round(val * 0.5 + 2, 6) AS val FROM v WHERE trace IN (SELECT trace FROM v GROUP BY 1 HAVING max(abs(val)) > 0) AND z_idx BETWEEN 2 AND 30 AND z_idx % 2 = 0")
def q_seis_copy(spark, sf):
    rows = trace_view(spark, sf).select("trace", "z_idx", F.when(F.col("trace") % 3 == 0, 0.0).otherwise(F.col("val")).alias("val"))
    return positions.without_null_traces(rows, "trace", "val").where(points.in_range("z_idx", 2, 30, 2)).select("trace", "z_idx", r(F.col("val") * 0.5 + 2).alias("val"))


@query("WITH m AS (SELECT l_suppkey AS well, min(l_quantity) FILTER (l_returnflag = 'A') + 2 AS top, max(l_quantity) FILTER (l_returnflag = 'R') - 3 AS bottom, min(l_quantity) AS first, max(l_quantity) AS last FROM lineitem GROUP BY 1) SELECT well, greatest(top, first) AS start, least(bottom, last) AS stop FROM m WHERE greatest(top, first) <= least(bottom, last)")
def q_z_range_selector(spark, sf):
    at = lambda f, flag: f(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    m = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("well")).agg((at(F.min, "A") + 2).alias("top"), (at(F.max, "R") - 3).alias("bottom"), F.min("l_quantity").alias("first"), F.max("l_quantity").alias("last"))
    return m.select("well", F.greatest("top", "first").alias("start"), F.least("bottom", "last").alias("stop")).where("start <= stop")
