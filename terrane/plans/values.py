"""Queries of single values, small tables and scans of stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import earth, traces, values
from terrane.plans.registry import query, r
from terrane.plans.views import G, T, grid, load
from terrane.plans.views import traces as trace_view


@query("SELECT c_custkey, round(5 + 0.5 * c_acctbal, 4) AS linear, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS log, round(exp(c_acctbal / 5000), 6) AS exp, round(c_acctbal / (1 + abs(c_acctbal)), 9) AS asymptotic FROM customer")
def q_scalers(spark, sf):
    v = F.col("c_acctbal")
    made = {"linear": (v, 5.0, 0.5, 4), "log": (v, 0.0, 1.0, 6), "exp": (v / 5000, 0.0, 1.0, 6), "asymptotic": (v, 0.0, 1.0, 9)}
    return load(spark, sf, "customer").select("c_custkey", *[r(values.scaled(k, x, a, b), d).alias(k) for k, (x, a, b, d) in made.items()])


@query("SELECT c_custkey, round(((c_acctbal + 180) % 360 + 360) % 360 - 180, 6) AS angle FROM customer")
def q_periodic_values(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", r(values.wrapped(F.col("c_acctbal"), 360.0, -180.0)).alias("angle"))


@query(r"""SELECT p_partkey, CAST(regexp_full_match(p_brand, '[A-Za-z0-9]+') AS INTEGER) AS alnum, CAST(regexp_full_match(p_name, '[a-z]+') AS INTEGER) AS lower, CAST(regexp_full_match(right(p_brand, 1), '[0-9]+') AS INTEGER) AS digit,
CASE WHEN length(p_name) >= 3 THEN p_name[2:3] END AS part, CASE WHEN length(p_name) >= 4 THEN reverse(right(p_name, 4)) END AS turned FROM part""")
def q_macro_strings(spark, sf):
    name = F.col("p_name")
    return load(spark, sf, "part").select(
        "p_partkey", values.all_of(F.col("p_brand"), "alnum").alias("alnum"), values.all_of(name, "lower").alias("lower"), values.all_of(F.right("p_brand", F.lit(1)), "digit").alias("digit"),
        values.part_of(name, 2, 3).alias("part"), values.part_of(name, -1, -4).alias("turned"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity AS q, list_sort([l_quantity, l_tax * 100, l_discount * 1000, CAST(l_linenumber AS DOUBLE)])[2] / 2 + list_sort([l_quantity, l_tax * 100, l_discount * 1000, CAST(l_linenumber AS DOUBLE)])[3] / 2 AS median FROM lineitem")
def q_macro_median(spark, sf):
    c = [F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 1000, F.col("l_linenumber").cast("double")]
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), values.mean_median(c).alias("median"))


@query("SELECT p_partkey, round(310 * power(p_retailprice, 0.25), 5) AS density, round((p_retailprice - 1360) / 1.16, 5) AS vs, round(coalesce(CASE WHEN p_size > 25 THEN p_size * 100.0 END, 310 * power(p_retailprice, 0.25)), 5) AS filled FROM part")
def q_rock_physics(spark, sf):
    vp = F.col("p_retailprice")
    filled = F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size") * 100.0), values.gardner(vp))
    return load(spark, sf, "part").select("p_partkey", r(values.gardner(vp), 5).alias("density"), r(values.mudrock(vp), 5).alias("vs"), r(filled, 5).alias("filled"))


@query("SELECT p_partkey, round(CASE WHEN p_size >= 30 THEN 1.0 + (p_size - 30) * 0.03 WHEN p_size >= 10 THEN 0.5 + (p_size - 10) * 0.025 ELSE p_size * 0.05 END, 6) AS time FROM part")
def q_time_depth_model(spark, sf):
    return load(spark, sf, "part").select("p_partkey", r(values.interpolated(F.col("p_size"), [(0, 0.0), (10, 0.5), (30, 1.0), (40, 1.3)])).alias("time"))


@query(f"""WITH {T}, k AS (SELECT trace, z_idx, (val - 10) / 20 AS a FROM t), i AS (SELECT *, CAST(floor(a) AS INTEGER) AS k FROM k)
SELECT trace, z_idx, round(CASE WHEN a >= 0 AND a <= 4 THEN w[k + 1] + (a - k) * (coalesce(w[k + 2], 0) - w[k + 1]) ELSE 0 END, 6) AS density FROM (SELECT *, [0.1, 0.4, 0.3, 0.15, 0.05]::DOUBLE[] AS w FROM i)""")
def q_pdf_sampled(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", r(values.density(F.col("val"), 10.0, 20.0, [0.1, 0.4, 0.3, 0.15, 0.05])).alias("density"))


@query(f"WITH {G} SELECT inl, crl, z, least(45, greatest(25, val)) AS val FROM g WHERE inl % 2 = 0 AND crl % 3 = 0")
def q_seis_resample(spark, sf):
    return values.clipped(grid(spark, sf), 25.0, 45.0, {"inl": 2, "crl": 3})


@query(f"WITH {G} SELECT a.inl, a.crl, a.z, round(avg(b.val), 5) AS stack, count(b.val) AS fold FROM g a JOIN g b ON a.z = b.z AND abs(a.inl - b.inl) + abs(a.crl - b.crl) <= 1 GROUP BY ALL")
def q_ps_lateral_stack(spark, sf):
    got = values.pattern_stack(grid(spark, sf).withColumn("offset", F.lit(0)), 1)
    return got.select("inl", "crl", "z", r("stack", 5).alias("stack"), "fold")


@query(f"""WITH {T}, e AS (SELECT trace AS pos, z_idx AS ez FROM (SELECT *, lag(val) OVER w AS b, lead(val) OVER w AS n FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)) WHERE val > b AND val >= n), h AS (SELECT trace AS pos, CAST(max(z_idx) // 2 AS INTEGER) AS z FROM t GROUP BY trace)
SELECT h.pos, h.z, CAST(arg_min(ez, abs(ez - z) * 2 + CASE WHEN ez > z THEN 1 ELSE 0 END) AS DOUBLE) AS event FROM h LEFT JOIN e ON e.pos = h.pos AND abs(ez - z) <= 6 GROUP BY ALL""")
def q_horizon_snap(spark, sf):
    rows, w = trace_view(spark, sf), traces.along()
    events = rows.withColumn("peak", (F.col("val") > F.lag("val").over(w)) & (F.col("val") >= F.lead("val").over(w))).where("peak").select(F.col("trace").alias("pos"), F.col("z_idx").alias("ez"))
    horizon = rows.groupBy(F.col("trace").alias("pos")).agg(F.floor(F.max("z_idx") / 2).cast("int").alias("z"))
    return values.snapped(horizon, events, 6).withColumn("event", F.col("event").cast("double"))


@query("WITH e AS (SELECT l_suppkey AS inl, CAST(l_quantity AS BIGINT) AS crl, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, coalesce(crl - lag(crl) OVER (PARTITION BY inl ORDER BY crl) - 1, 0) AS missing FROM e) SELECT inl, min(crl) AS first, max(crl) AS last, CAST(sum(n) AS BIGINT) AS traces, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(n - 1) AS BIGINT) AS repeats FROM k GROUP BY 1")
def q_seis_scanner(spark, sf):
    return values.gaps(load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("inl"), F.col("l_quantity").cast("long").alias("crl")))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(power(l_linenumber * 0.2, 2) + power(l_quantity * 50, 2) / power(2500, 2)), 6) AS t FROM lineitem")
def q_normal_moveout(spark, sf):
    t = earth.moveout(F.col("l_linenumber") * 0.2, F.col("l_quantity") * 50, F.lit(2500.0))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(t).alias("t"))


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS a, max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS n, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS r FROM lineitem GROUP BY 1")
def q_prestack_as_cube(spark, sf):
    got = load(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_extendedprice"))
    return got.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT event_id, map_keys(m) AS names, m['ev.type'] AS kind, len(map_keys(m)) AS n FROM (SELECT event_id, CASE WHEN value > 50 THEN MAP {'ev.type': event_type, 'ev.size': 'large'} ELSE MAP {'ev.type': event_type} END AS m FROM events)".replace("map_keys(m) AS names", "array_to_string(list_sort(map_keys(m)), ',') AS names"))
def q_parameter_maps(spark, sf):
    base = F.create_map(F.lit("ev.type"), F.col("event_type"), F.lit("id"), F.lit("x"))
    more = F.when(F.col("value") > 50, F.create_map(F.lit("ev.size"), F.lit("large"))).otherwise(F.create_map().cast("map<string,string>"))
    m = F.map_filter(F.map_concat(base, more), lambda k, v: k.startswith("ev."))
    return load(spark, sf, "events").select("event_id", m.alias("m")).select("event_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"), F.col("m")["ev.type"].alias("kind"), F.size("m").cast("long").alias("n"))


@query("SELECT DISTINCT p_type AS name FROM part WHERE p_size < 10 INTERSECT SELECT p_type FROM part WHERE p_size > 40")
def q_stringset_common(spark, sf):
    p = load(spark, sf, "part")
    return p.where("p_size < 10").select(F.col("p_type").alias("name")).intersect(p.where("p_size > 40").select("p_type"))
