"""The queries: each applies one operator to a view of the driver's tables, beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.functions.formula import formula, recursive
from terrane.operators import earth, graph, points, traces
from terrane.operators import signals as sig
from terrane.operators import values
from terrane.plans import values as _values  # noqa: F401
from terrane.plans import cubes, models, positions, signals, stores, surfaces, ties, volumes  # noqa: F401  (they register their queries)
from terrane.plans.registry import QUERIES, SQL, query, r  # noqa: F401
from terrane.plans.views import G, H, L, T, grid, horizons, load, logs
from terrane.plans.views import traces as trace_view

def col(name: str):
    return F.col(name)


# ---- statistics


@query(f"WITH {T} SELECT trace, count(val) AS n, round(avg(val), 6) AS average, round(sum(val), 4) AS total, round(sum(val * val), 3) AS sqsum, round(sqrt(avg(val * val)), 6) AS rms, min(val) AS low, max(val) AS high FROM t GROUP BY trace")
def q_stat_basic(spark, sf):
    v = F.col("val")
    return trace_view(spark, sf).groupBy("trace").agg(F.count(v).alias("n"), r(F.avg(v)).alias("average"), r(F.sum(v), 4).alias("total"), r(F.sum(v * v), 3).alias("sqsum"), r(stats.rms(v)).alias("rms"), F.min(v).alias("low"), F.max(v).alias("high"))


@query(f"WITH {T} SELECT trace, event_type, round(coalesce(var_samp(val), 0), 4) AS variance, round(sqrt(coalesce(var_samp(val), 0)), 5) AS stddev, round(coalesce(var_samp(val) / (avg(val) * avg(val) + 0.1 * var_samp(val)), 0), 6) AS norm FROM t GROUP BY ALL")
def q_stat_variance(spark, sf):
    v = F.col("val")
    return trace_view(spark, sf).groupBy("trace", "event_type").agg(r(stats.variance(v), 4).alias("variance"), r(stats.stddev(v), 5).alias("stddev"), r(stats.norm_variance(v)).alias("norm"))


@query(f"WITH {T}, c AS (SELECT trace, val - 50 AS x FROM t) SELECT trace, CASE WHEN abs(max(x)) < abs(min(x)) THEN min(x) ELSE max(x) END AS extreme FROM c GROUP BY trace")
def q_stat_extreme(spark, sf):
    return trace_view(spark, sf).groupBy("trace").agg(stats.extreme(F.col("val") - 50).alias("extreme"))


@query(f"WITH {T} SELECT trace, quantile_disc(val, 0.5) AS median FROM t GROUP BY trace")
def q_stat_median_low(spark, sf):
    return trace_view(spark, sf).groupBy("trace").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY val)").alias("median"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wmean, round(sqrt(sum(l_extendedprice * l_extendedprice * l_quantity) / sum(l_quantity)), 4) AS wrms FROM lineitem GROUP BY l_suppkey")
def q_stat_weighted(spark, sf):
    v, w = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(stats.weighted_mean(v, w), 4).alias("wmean"), r(stats.weighted_rms(v, w), 4).alias("wrms"))


@query("WITH c AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS cls, count(*) AS w FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, cls) AS rn FROM c) SELECT l_suppkey, cls, w FROM k WHERE rn = 1")
def q_stat_mostfreq(spark, sf):
    c = load(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("w"))
    return c.groupBy("l_suppkey").agg(F.max_by(F.struct("cls", "w"), F.struct("w", -F.col("cls"))).alias("b")).select("l_suppkey", "b.cls", "b.w")


@query(f"WITH {T} SELECT trace, round(CASE WHEN count(val) < 3 OR max(val) = min(val) THEN 0 ELSE greatest(avg(val) - min(val), max(val) - avg(val)) / stddev_pop(val) END, 6) AS grubbs FROM t GROUP BY trace")
def q_grubbs_test(spark, sf):
    return trace_view(spark, sf).groupBy("trace").agg(r(stats.grubbs(F.col("val"))).alias("grubbs"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS correlation FROM lineitem GROUP BY l_suppkey")
def q_lin_stats_2d(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(F.regr_slope(y, x), 4).alias("slope"), r(F.regr_intercept(y, x), 3).alias("intercept"), r(F.corr(y, x)).alias("correlation"))


@query("SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def q_histogram(spark, sf):
    return load(spark, sf, "events").groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {T} SELECT trace, z_idx, round(sum(val) OVER w, 4) AS run_sum, count(val) OVER w AS run_n, max(val) OVER w AS run_max FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx ROWS UNBOUNDED PRECEDING)")
def q_running_calc(spark, sf):
    w = traces.along().rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("val")
    return trace_view(spark, sf).select("trace", "z_idx", r(F.sum(v).over(w), 4).alias("run_sum"), F.count(v).over(w).alias("run_n"), F.max(v).over(w).alias("run_max"))


@query(f"WITH {T} SELECT trace, z_idx, round(avg(val) OVER w, 6) AS average, min(val) OVER w AS low FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx ROWS 9 PRECEDING)")
def q_windowed_calc(spark, sf):
    w, v = traces.gate(-9, 0), F.col("val")
    return trace_view(spark, sf).select("trace", "z_idx", r(F.avg(v).over(w)).alias("average"), F.min(v).over(w).alias("low"))


@query(f"WITH {T}, n AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY val, z_idx) - 1 AS k, count(*) OVER (PARTITION BY trace) AS n FROM t) SELECT trace, min(CASE WHEN k = CAST(round(0.1 * n) AS BIGINT) THEN val END) AS low, min(CASE WHEN k = n - CAST(round(0.1 * n) AS BIGINT) - 1 THEN val END) AS high FROM n GROUP BY trace")
def q_data_clipper(spark, sf):
    w = Window.partitionBy("trace")
    rows = trace_view(spark, sf).withColumns({"k": F.row_number().over(w.orderBy("val", "z_idx")) - 1, "n": F.count(F.lit(1)).over(w)})
    cut = F.round(F.lit(0.1) * F.col("n")).cast("long")
    return rows.groupBy("trace").agg(F.min(F.when(F.col("k") == cut, F.col("val"))).alias("low"), F.min(F.when(F.col("k") == F.col("n") - cut - 1, F.col("val"))).alias("high"))


@query(f"WITH {T}, s AS (SELECT ntile(8) OVER (PARTITION BY trace ORDER BY val, z_idx) AS seg, trace, val FROM t) SELECT trace, CAST(seg AS INTEGER) AS seg, min(val) AS low, max(val) AS high, count(*) AS n FROM s GROUP BY ALL")
def q_hist_equalizer(spark, sf):
    rows = trace_view(spark, sf).withColumn("seg", F.ntile(8).over(Window.partitionBy("trace").orderBy("val", "z_idx")))
    return rows.groupBy("trace", "seg").agg(F.min("val").alias("low"), F.max("val").alias("high"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {T} SELECT CAST(b.z_idx - a.z_idx AS INTEGER) AS lag, count(*) AS n, round(avg((a.val - b.val) * (a.val - b.val)) / 2, 4) AS gamma FROM t a JOIN t b ON a.trace = b.trace AND b.z_idx - a.z_idx BETWEEN 1 AND 5 GROUP BY 1")
def q_variogram_vertical(spark, sf):
    rows = trace_view(spark, sf)
    d = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("val", k).over(traces.along()) - F.col("val")).alias("d")) for k in range(1, 6)])
    each = rows.select(d.alias("steps")).select(F.explode("steps").alias("x")).select("x.*").where("d IS NOT NULL")
    return each.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("d") * F.col("d")) / 2, 4).alias("gamma"))


@query("WITH c AS (SELECT p_partkey % 10 AS grp, p_size AS cls, sum(p_retailprice) AS w FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, cls) AS rn FROM c) SELECT grp, cls, round(w, 2) AS weight FROM k WHERE rn = 1")
def q_weighted_class_counter(spark, sf):
    c = load(spark, sf, "part").groupBy((F.col("p_partkey") % 10).alias("grp"), F.col("p_size").alias("cls")).agg(F.sum("p_retailprice").alias("w"))
    return c.groupBy("grp").agg(F.max_by(F.struct("cls", "w"), F.struct("w", -F.col("cls"))).alias("b")).select("grp", "b.cls", r("b.w", 2).alias("weight"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_top_list(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("WITH d AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS part, CAST(floor((l_discount * 1000) / 25) AS BIGINT) AS sector, l_extendedprice AS v FROM lineitem) SELECT part, sector, count(*) AS n, round(avg(v), 4) AS average FROM d GROUP BY ALL")
def q_directional_stats(spark, sf):
    d = load(spark, sf, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("part"), F.floor(F.col("l_discount") * 1000 / 25).alias("sector"), F.col("l_extendedprice").alias("v"))
    return d.groupBy("part", "sector").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v"), 4).alias("average"))


# ---- attributes of traces


@query(f"WITH {T}, e AS (SELECT trace, z_idx, sum(val * val) OVER (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM t) SELECT trace, z_idx, round(e, 4) AS energy, round(sqrt(e), 6) AS root, CASE WHEN e > 0 THEN round(ln(e), 6) END AS log FROM e")
def q_energy(spark, sf):
    return traces.energy(trace_view(spark, sf), -2, 2).select("trace", "z_idx", r("energy", 4).alias("energy"), r("root").alias("root"), r("log").alias("log"))


@query(f"WITH {T}, n AS (SELECT *, lag(val) OVER w AS b, lead(val) OVER w AS a FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)) SELECT trace, z_idx, round(CASE WHEN b IS NULL THEN a - val WHEN a IS NULL THEN val - b ELSE (a - b) / 2 END, 6) AS gradient FROM n")
def q_gradient(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", r(traces.gradient()).alias("gradient"))


@query(f"WITH {T}, n AS (SELECT *, sqrt(avg(val * val) OVER (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS l FROM t) SELECT trace, z_idx, round(CASE WHEN l = 0 THEN 0 ELSE val / l END, 6) AS agc FROM n")
def q_agc(spark, sf):
    return traces.agc(trace_view(spark, sf), -10, 10).select("trace", "z_idx", r("agc").alias("agc"))


@query(f"WITH {T}, f AS (SELECT trace, regr_slope(val, z_idx) AS s, avg(val) AS m, avg(CAST(z_idx AS DOUBLE)) AS z FROM t GROUP BY trace) SELECT t.trace, z_idx, round(val - m - coalesce(s, 0) * (z_idx - z), 4) AS detrended FROM t JOIN f ON t.trace = f.trace")
def q_scaling_detrend(spark, sf):
    return traces.detrend(trace_view(spark, sf)).select("trace", "z_idx", r("detrended", 4).alias("detrended"))


@query(f"WITH {T} SELECT trace, z_idx, round(val * power(z_idx + 1, 1.5), 4) AS scaled FROM t")
def q_scaling_zpower(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", r(F.col("val") * F.pow(F.col("z_idx") + 1, F.lit(1.5)), 4).alias("scaled"))


@query(f"WITH {T}, n AS (SELECT *, avg(val) OVER w AS m, stddev_pop(val) OVER w AS s FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) SELECT trace, z_idx, round(CASE WHEN s > 0 AND abs(val - m) / s > 2 THEN m ELSE val END, 5) AS despiked FROM n")
def q_despike(spark, sf):
    return traces.despike(trace_view(spark, sf), -8, 8, 2.0).select("trace", "z_idx", r("despiked", 5).alias("despiked"))


@query(f"WITH {T} SELECT trace, z_idx, round((lag(val, 2) OVER w + 2 * lag(val) OVER w + 4 * val + 2 * lead(val) OVER w + lead(val, 2) OVER w) / 10, 5) AS convolved FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)")
def q_convolve_kernel(spark, sf):
    return traces.convolved(trace_view(spark, sf), [1, 2, 4, 2, 1]).select("trace", "z_idx", r("convolved", 5).alias("convolved"))


@query(f"""WITH {T}, i AS (SELECT a.trace, a.z_idx, any_value(a.val) AS val, sum(b.val * CASE WHEN (b.z_idx - a.z_idx) % 2 <> 0 THEN -2 / (pi() * (b.z_idx - a.z_idx)) * (0.54 + 0.46 * cos(pi() * (b.z_idx - a.z_idx) / 16)) ELSE 0 END) AS im FROM t a JOIN t b ON a.trace = b.trace AND abs(b.z_idx - a.z_idx) <= 15 GROUP BY ALL),
p AS (SELECT trace, z_idx, sqrt(val * val + im * im) AS amp, atan2(im, val) AS ph FROM i),
q AS (SELECT *, lead(ph) OVER w - lag(ph) OVER w AS d FROM p WINDOW w AS (PARTITION BY trace ORDER BY z_idx)),
f AS (SELECT *, (CASE WHEN d < 0 THEN d + 2 * pi() ELSE d END) / (4 * pi()) AS fr FROM q)
SELECT trace, z_idx, round(amp, 5) AS amplitude, round(ph, 6) AS phase, round(fr, 6) AS frequency, round(CASE WHEN fr > 0 THEN amp / sqrt(fr) WHEN fr IS NOT NULL THEN 0 END, 4) AS sweetness FROM f""")
def q_instantaneous(spark, sf):
    rows = trace_view(spark, sf).select("trace", "z_idx", "val", sig.kernel_sum(sig.hilbert_kernel(15)).alias("imag"))
    return traces.instantaneous(rows).select("trace", "z_idx", r("amplitude", 5).alias("amplitude"), r("phase").alias("phase"), r("frequency").alias("frequency"), r("sweetness", 4).alias("sweetness"))


@query(f"""WITH {T}, p AS (SELECT a.trace AS pair, a.z_idx, a.val AS a, b.val AS b FROM t a JOIN t b ON b.trace = a.trace + 1 AND a.z_idx = b.z_idx),
s AS (SELECT *, sqrt(sum((a - b) * (a - b)) OVER w) AS d, sqrt(sum(a * a) OVER w) AS ea, sqrt(sum(b * b) OVER w) AS eb, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY pair ORDER BY z_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT pair, z_idx, round(CASE WHEN n < 7 THEN NULL WHEN ea = 0 AND eb = 0 THEN 1 WHEN ea = 0 OR eb = 0 THEN 0 ELSE 1 - d / (ea + eb) END, 6) AS similarity FROM s""")
def q_similarity_pair(spark, sf):
    rows = trace_view(spark, sf)
    a = rows.select(F.col("trace").alias("pair"), "z_idx", F.col("val").alias("a"))
    b = rows.select((F.col("trace") - 1).alias("pair"), "z_idx", F.col("val").alias("b"))
    return traces.similarity(a.join(b, ["pair", "z_idx"]), -3, 3).select("pair", "z_idx", r("similarity").alias("similarity"))


@query(f"""WITH {T}, q AS (SELECT trace, z_idx, CAST(greatest(0, least(7, floor((val - 0) * 7 / 100))) AS INTEGER) AS m FROM t),
s AS (SELECT trace, m, lead(m) OVER (PARTITION BY trace ORDER BY z_idx) AS n FROM q), b AS (SELECT trace, m, n FROM s WHERE n IS NOT NULL UNION ALL SELECT trace, n, m FROM s WHERE n IS NOT NULL),
c AS (SELECT trace, m, n, count(*) AS c FROM b GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY trace) AS p FROM c)
SELECT trace, round(sum(p * (m - n) * (m - n)), 6) AS contrast, round(sum(p / (1 + (m - n) * (m - n))), 6) AS homogeneity, round(sum(p * p), 6) AS asm, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY trace""")
def q_texture_glcm(spark, sf):
    got = traces.grey_levels(trace_view(spark, sf), 8, 0.0, 100.0)
    return got.select("trace", *[r(c).alias(c) for c in ("contrast", "homogeneity", "asm", "entropy")])


@query(f"WITH {G} SELECT a.inl, a.crl, a.z, count(*) AS n, round(avg(b.val), 5) AS average, min(b.val) AS low, max(b.val) AS high, round(sqrt(avg(b.val * b.val)), 5) AS rms, round(coalesce(var_samp(b.val), 0), 3) AS variance FROM g a JOIN g b ON a.z = b.z AND abs(a.inl - b.inl) <= 1 AND abs(a.crl - b.crl) <= 1 GROUP BY ALL")
def q_volstats_box(spark, sf):
    got = traces.volume_statistics(grid(spark, sf), 1, 1)
    return got.select("inl", "crl", "z", "n", r("average", 5).alias("average"), "low", "high", r("rms", 5).alias("rms"), r("variance", 3).alias("variance"))


@query(f"WITH {G} SELECT a.inl, a.crl, a.z, round(sum(b.val) * sum(b.val) / (count(*) * sum(b.val * b.val)), 6) AS semblance FROM g a JOIN g b ON a.z = b.z AND abs(a.inl - b.inl) <= 1 AND abs(a.crl - b.crl) <= 1 GROUP BY ALL")
def q_semblance_box(spark, sf):
    return traces.semblance(grid(spark, sf), 1, 1).select("inl", "crl", "z", r("semblance").alias("semblance"))


@query(f"WITH {T}, n AS (SELECT trace, z_idx, val, arg_max(z_idx, (val, -z_idx)) OVER (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS place FROM t) SELECT trace, z_idx, place FROM n")
def q_position_argmax(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", F.max_by("z_idx", F.struct("val", -F.col("z_idx"))).over(traces.gate(-4, 4)).alias("place"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.1) * (CAST(x AS DOUBLE) - 0.1)))), 5) AS distance FROM embeddings")
def q_fingerprint(spark, sf):
    d = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") - 0.1) * (x.cast("double") - 0.1))
    return load(spark, sf, "embeddings").select("vec_id", r(F.sqrt(d), 5).alias("distance"))


@query(f"WITH {T} SELECT trace, z_idx, CAST(z_idx + 1 AS INTEGER) AS sample_nr, lag(val, 2) OVER (PARTITION BY trace ORDER BY z_idx) AS shifted FROM t")
def q_shift_trace(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", (F.col("z_idx") + 1).alias("sample_nr"), F.lag("val", 2).over(traces.along()).alias("shifted"))


# ---- formulas and scalars


@query(f"WITH {T} SELECT trace, z_idx, round(3 + val * 2 - power(val / 10, 2), 7) AS a, CASE WHEN val > 50 THEN val - 50 ELSE 50 - val END AS b, CAST((val > 20 AND val < 60) OR val > 90 AS DOUBLE) AS c FROM t")
def q_formula_arith(spark, sf):
    v = {"x": F.col("val")}
    return trace_view(spark, sf).select("trace", "z_idx", r(formula("3 + x*2 - (x/10)^2", v), 7).alias("a"), formula("x > 50 ? x - 50 : 50 - x", v).alias("b"), formula("(x > 20 && x < 60) || x > 90", v).alias("c"))


@query(f"WITH {T} SELECT trace, z_idx, round(lag(val) OVER w + 2 * val + lead(val) OVER w, 5) AS shifted FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)")
def q_formula_shift(spark, sf):
    return trace_view(spark, sf).select("trace", "z_idx", r(formula("x[-1] + 2*x + x[1]", {"x": F.col("val")}, traces.along()), 5).alias("shifted"))


@query()
def q_formula_recursive(spark, sf):
    series = F.transform(F.array_sort(F.collect_list(F.struct("z_idx", "val"))), lambda s: s["val"])
    out = recursive(F.col("series"), lambda x, last: x - 0.5 * F.element_at(last, 1), [0.0, 0.0])
    return trace_view(spark, sf).groupBy("trace").agg(series.alias("series")).select("trace", F.posexplode(out).alias("z_idx", "out")).select("trace", "z_idx", r("out").alias("out"))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice < 50000 THEN 40000 - 1e8 / (o_totalprice - 60000) WHEN o_totalprice > 150000 THEN 180000 - 9e8 / (o_totalprice - 120000) ELSE o_totalprice END, 2) AS squeezed, CASE WHEN o_totalprice > 150000 THEN 150000 ELSE o_totalprice END AS clipped FROM orders")
def q_data_squeezer(spark, sf):
    p = F.col("o_totalprice")
    return load(spark, sf, "orders").select("o_orderkey", r(values.squeezed(p, 40000.0, 180000.0, 50000.0, 150000.0), 2).alias("squeezed"), values.squeezed(p, None, 150000.0).alias("clipped"))


@query("SELECT p_partkey, regexp_matches(p_name, '^.*[aeiou].$') AS a, p_brand LIKE 'Brand_1_' AS b FROM part")
def q_glob_match(spark, sf):
    return load(spark, sf, "part").select("p_partkey", points.glob(F.col("p_name"), "*[aeiou]?").alias("a"), points.glob(F.col("p_brand"), "Brand?1?").alias("b"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def q_date_parts(spark, sf):
    d = F.col("o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.dayofweek(d).alias("weekday"), F.datediff(d, F.lit("1992-01-01").cast("date")).alias("days"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, length(p_name) AS n, replace(p_brand, 'Brand', 'B') AS short, reverse(p_name) AS back, starts_with(p_name, 'a') AS a FROM part")
def q_string_functions(spark, sf):
    n = F.col("p_name")
    return load(spark, sf, "part").select("p_partkey", F.upper(n).alias("up"), F.lower("p_type").alias("low"), F.length(n).cast("long").alias("n"), F.replace("p_brand", F.lit("Brand"), F.lit("B")).alias("short"), F.reverse(n).alias("back"), F.startswith(n, F.lit("a")).alias("a"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal) ELSE floor(c_acctbal) END AS trunc, round(c_acctbal) AS rounded, round(c_acctbal * 0.3048, 4) AS metres, round(atan2(c_acctbal, 100), 6) AS angle FROM customer")
def q_macro_numbers(spark, sf):
    b = F.col("c_acctbal")
    return load(spark, sf, "customer").select("c_custkey", F.when(b < 0, F.ceil(b)).otherwise(F.floor(b)).cast("double").alias("trunc"), F.round(b).alias("rounded"), r(b * 0.3048, 4).alias("metres"), r(F.atan2(b, F.lit(100.0))).alias("angle"))


# ---- selection and points


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey BETWEEN 3 AND 60 AND (l_suppkey - 3) % 4 = 0 AND l_linenumber BETWEEN 1 AND 5 AND (l_linenumber - 1) % 2 = 0")
def q_sel_range(spark, sf):
    return load(spark, sf, "lineitem").where(points.in_range("l_suppkey", 3, 60, 4) & points.in_range("l_linenumber", 1, 5, 2)).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def q_sel_table(spark, sf):
    rich = load(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def q_anti_selection(spark, sf):
    rich = load(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(rich, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("WITH e(x1, y1, x2, y2) AS (VALUES (5.0, 905.0, 44.0, 930.0), (44.0, 930.0, 30.0, 985.0), (30.0, 985.0, 22.0, 940.0), (22.0, 940.0, 5.0, 905.0)), p AS (SELECT p_partkey, p_size AS x, 900 + p_partkey % 97 AS y FROM part) SELECT p_partkey FROM p WHERE (SELECT count(*) FROM e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1")
def q_sel_polygon(spark, sf):
    corners = [(5.0, 905.0), (44.0, 930.0), (30.0, 985.0), (22.0, 940.0)]
    return load(spark, sf, "part").where(points.in_polygon(F.col("p_size").cast("double"), (900 + F.col("p_partkey") % 97).cast("double"), corners)).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200")
def q_dps_subselect(spark, sf):
    return points.subselect(load(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], {"o_totalprice": (1000, 90000)}, 200, "o_orderkey")


@query("WITH n AS (SELECT c.c_custkey AS id, s.s_suppkey AS oid, (c.c_acctbal - s.s_acctbal) * (c.c_acctbal - s.s_acctbal) + CAST((c.c_nationkey - s.s_nationkey) * (c.c_nationkey - s.s_nationkey) AS DOUBLE) AS d2 FROM customer c JOIN supplier s ON true), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, oid) AS k FROM n WHERE d2 <= 2500) SELECT id, oid, round(sqrt(d2), 5) AS distance FROM b WHERE k = 1")
def q_dps_find_nearest(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_acctbal").alias("ox"), F.col("s_nationkey").cast("double").alias("oy"))
    return points.nearest(c, s, 50.0).select("id", "oid", r("distance", 5).alias("distance"))


@query("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_type LIKE '%STEEL%'")
def q_record_matcher(spark, sf):
    return load(spark, sf, "part").where(points.matches({"p_brand": "Brand#1*", "p_type": "*STEEL*"}, any_of=True)).select("p_partkey")


@query("WITH n AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id FROM n WHERE k = 1 OR event_type IS DISTINCT FROM b")
def q_duplicate_key_remover(spark, sf):
    return points.new_keys(load(spark, sf, "events"), ["event_type"], ["ts", "event_id"], ["user_id"]).select("event_id")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def q_sql_search_latest(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("k")).where("k = 1")


@query("SELECT doc_id FROM documents WHERE list_has_any(string_split(lower(text), ' '), ['the', 'les']) AND text LIKE '%and%'")
def q_sql_full_text(spark, sf):
    return load(spark, sf, "documents").where(F.arrays_overlap(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("les"))) & F.col("text").contains("and")).select("doc_id")


@query(f"WITH {L} SELECT well FROM l WHERE log IN ('click', 'view', 'purchase') GROUP BY well HAVING count(DISTINCT log) = 3")
def q_well_relational_division(spark, sf):
    return points.holds_all(logs(spark, sf), "well", "log", ["click", "view", "purchase"])


@query(f"WITH {L} SELECT well, log, count(*) AS n, min(dah) AS top, max(dah) AS base FROM l WHERE dah BETWEEN 10 AND 40 GROUP BY ALL")
def q_well_logs_in_zone(spark, sf):
    return logs(spark, sf).where(F.col("dah").between(10, 40)).groupBy("well", "log").agg(F.count(F.lit(1)).alias("n"), F.min("dah").alias("top"), F.max("dah").alias("base"))


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS cx, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS cy, count(*) AS n FROM lineitem GROUP BY ALL")
def q_crossplot_density(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("cx"), F.floor(F.col("l_extendedprice") / 5000).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(least(p_size - 5, 45 - p_size, p_retailprice - 950, 1500 - p_retailprice) / 20, 6) AS selectedness FROM part WHERE p_size BETWEEN 5 AND 45 AND p_retailprice BETWEEN 950 AND 1500")
def q_crossplot_selectedness(spark, sf):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return load(spark, sf, "part").where(s.between(5, 45) & p.between(950, 1500)).select("p_partkey", r(F.least((s - 5).cast("double"), (45 - s).cast("double"), p - 950, 1500 - p) / 20).alias("selectedness"))


# ---- joins, merges, horizons


def _two(spark, sf, a="F", b="O"):
    h = horizons(spark, sf)
    return h.where(F.col("hor") == a).drop("hor"), h.where(F.col("hor") == b).drop("hor")


for _policy, _pick in (("keep", "CASE WHEN a.pos IS NOT NULL THEN a.z ELSE b.z END"), ("fill", "coalesce(a.z, b.z)"), ("overwrite", "CASE WHEN b.pos IS NOT NULL THEN b.z ELSE a.z END")):

    def _merge(spark, sf, policy=_policy):
        return points.merge(*_two(spark, sf, "P", "O"), ["pos"], "z", policy)

    QUERIES[f"posvec_merge_{_policy}"] = _merge
    SQL[f"posvec_merge_{_policy}"] = f"WITH {H}, a AS (SELECT * FROM h WHERE hor = 'P'), b AS (SELECT * FROM h WHERE hor = 'O') SELECT coalesce(a.pos, b.pos) AS pos, {_pick} AS z FROM a FULL JOIN b ON a.pos = b.pos"


@query(f"WITH {H}, k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY CASE hor WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) AS k FROM h) SELECT pos, z FROM k WHERE k = 1")
def q_merge_priority(spark, sf):
    h = horizons(spark, sf)
    return points.first_of([h.where(F.col("hor") == x).select("pos", "z") for x in "PFO"], ["pos"])


@query(f"WITH {H} SELECT pos, round(avg(z), 4) AS average, min(z) AS top, max(z) AS base FROM h GROUP BY pos")
def q_horizon_merge(spark, sf):
    h = horizons(spark, sf)
    return earth.merged(h, "average").select("pos", r("z", 4).alias("average")).join(earth.merged(h, "top").withColumnRenamed("z", "top"), "pos").join(earth.merged(h, "base").withColumnRenamed("z", "base"), "pos")


@query(f"WITH {H} SELECT a.pos, round(b.z - a.z, 3) AS isochron FROM h a LEFT JOIN (SELECT * FROM h WHERE hor = 'O') b ON a.pos = b.pos WHERE a.hor = 'F'")
def q_isochron(spark, sf):
    return earth.isochron(*_two(spark, sf)).select("pos", r("isochron", 3).alias("isochron"))


@query(f"WITH {H} SELECT a.hor AS a, b.hor AS b, count(*) FILTER (b.z > a.z) AS above, count(*) FILTER (b.z < a.z) AS below, round(coalesce(sum(b.z - a.z) FILTER (b.z > a.z), 0), 3) AS sum_above, round(coalesce(sum(b.z - a.z) FILTER (b.z < a.z), 0), 3) AS sum_below FROM h a JOIN h b ON a.pos = b.pos AND a.hor < b.hor AND a.z <> b.z GROUP BY ALL")
def q_horizon_crossings(spark, sf):
    return earth.crossings(horizons(spark, sf)).select("a", "b", "above", "below", r("sum_above", 3).alias("sum_above"), r("sum_below", 3).alias("sum_below"))


@query(f"WITH {T}, s AS (SELECT trace AS pos, min(val) AS lo, max(val) AS hi FROM t GROUP BY trace) SELECT s.pos, count(*) AS n, round(avg(t.val), 5) AS average, round(sqrt(avg(t.val * t.val)), 5) AS rms FROM s JOIN t ON s.pos = t.trace AND t.z_idx BETWEEN CAST(floor(s.lo) AS INTEGER) + 2 AND CAST(floor(s.hi) AS INTEGER) / 2 + 20 GROUP BY s.pos")
def q_strat_amplitude(spark, sf):
    t = trace_view(spark, sf)
    s = t.groupBy("trace").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    inside = F.col("z_idx").between(F.floor("lo") + 2, F.floor("hi") / 2 + 20)
    return t.join(s, "trace").where(inside).groupBy(F.col("trace").alias("pos")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("val"), 5).alias("average"), r(stats.rms(F.col("val")), 5).alias("rms"))


@query("SELECT l_partkey, CAST(l_linenumber AS BIGINT) AS z, count(*) AS fold, round(avg(l_extendedprice), 7) AS stacked FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 GROUP BY ALL")
def q_prestack_stack(spark, sf):
    li = load(spark, sf, "lineitem").where(F.col("l_quantity").between(5, 40))
    return li.groupBy("l_partkey", F.col("l_linenumber").cast("long").alias("z")).agg(F.count(F.lit(1)).alias("fold"), r(F.avg("l_extendedprice"), 7).alias("stacked"))


@query("SELECT l_partkey, round(regr_slope(l_extendedprice, l_quantity), 3) AS gradient, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_partkey HAVING regr_count(l_extendedprice, l_quantity) >= 5")
def q_prestack_lsq(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    got = load(spark, sf, "lineitem").groupBy("l_partkey").agg(r(F.regr_slope(y, x), 3).alias("gradient"), r(F.regr_intercept(y, x), 2).alias("intercept"), F.regr_count(y, x).alias("n"))
    return got.where("n >= 5")


@query(f"""WITH {G}, n AS (SELECT c.z AS year, c.inl, c.crl, b.inl - c.inl AS i, b.crl - c.crl AS k, b.val AS z FROM g c JOIN g b ON b.z = c.z AND abs(b.inl - c.inl) <= 1 AND abs(b.crl - c.crl) <= 1),
p AS (SELECT year, inl, crl, sum(CASE WHEN i = 0 THEN -z / 3 ELSE z / 6 END) AS a, sum(CASE WHEN k = 0 THEN -z / 3 ELSE z / 6 END) AS b, sum(z * i * k) / 4 AS c, sum(z * i) / 6 AS d, sum(z * k) / 6 AS e FROM n GROUP BY ALL HAVING count(*) = 9)
SELECT year, inl, crl, round((a * (1 + e * e) + b * (1 + d * d) - c * d * e) / power(1 + d * d + e * e, 1.5), 6) AS mean, round((4 * a * b - c * c) / power(1 + d * d + e * e, 2), 6) AS gauss, round(atan(sqrt(d * d + e * e)), 6) AS dip FROM p""")
def q_curvature_dip(spark, sf):
    g = grid(spark, sf).select(F.col("z").alias("year"), "inl", "crl", F.col("val").alias("z"))
    return earth.curvature(g, ["year"]).select("year", "inl", "crl", r("mean_curvature").alias("mean"), r("gauss_curvature").alias("gauss"), r("dip").alias("dip"))


@query(f"WITH {T}, f AS (SELECT trace AS key, z_idx, (z_idx + 1) / 10.0 AS t, 1500 + 20 * z_idx + val AS vrms FROM t), n AS (SELECT *, vrms * vrms * t AS e, lag(vrms * vrms * t, 1, 0) OVER w AS eb, lag(t, 1, 0) OVER w AS tb FROM f WINDOW w AS (PARTITION BY key ORDER BY t)) SELECT key, z_idx, CASE WHEN (e - eb) / (t - tb) >= 0 THEN round(sqrt((e - eb) / (t - tb)), 3) END AS vint FROM n")
def q_dix(spark, sf):
    f = trace_view(spark, sf).select(F.col("trace").alias("key"), "z_idx", ((F.col("z_idx") + 1) / 10.0).alias("t"), (1500 + 20 * F.col("z_idx") + F.col("val")).alias("vrms"))
    return earth.dix(f).select("key", "z_idx", r("vint", 3).alias("vint"))


@query(f"WITH {T}, f AS (SELECT trace AS key, z_idx, (z_idx + 1) / 10.0 AS t, 1500 + val AS v FROM t), n AS (SELECT *, t - lag(t, 1, 0) OVER (PARTITION BY key ORDER BY t) AS dt FROM f) SELECT key, z_idx, round(sqrt(sum(v * v * dt) OVER w / t), 8) AS vrms, round(sum(v * dt) OVER w / t, 8) AS vavg, round(sum(v * dt / 2) OVER w, 8) AS depth FROM n WINDOW w AS (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING)")
def q_vrms(spark, sf):
    f = trace_view(spark, sf).select(F.col("trace").alias("key"), ((F.col("z_idx") + 1) / 10.0).cast("double").alias("t"), (1500 + F.col("val")).alias("vint"))
    return earth.rms_velocity(f).select("key", (F.round(F.col("t") * 10) - 1).cast("int").alias("z_idx"), *[r(c, 8).alias(c) for c in ("vrms", "vavg", "depth")])


@query("SELECT p_partkey, round(2000 * (exp(0.6 * (p_size / 10.0) / 2) - 1) / 0.6, 4) AS depth, round(sqrt((p_size / 10.0) * (p_size / 10.0) + 1000.0 * 1000.0 / (2000.0 * 2000.0)), 6) AS moveout FROM part")
def q_linear_velocity(spark, sf):
    t = (F.col("p_size") / 10.0).cast("double")
    return load(spark, sf, "part").select("p_partkey", r(earth.linear_depth(t, 2000.0, 0.6), 4).alias("depth"), r(earth.moveout(t, F.lit(1000.0), F.lit(2000.0))).alias("moveout"))


@query("WITH o AS (SELECT l_orderkey AS model, CAST(l_linenumber AS INTEGER) AS layer, sum(l_quantity) AS thickness, max(l_extendedprice) AS ai FROM lineitem GROUP BY ALL), n AS (SELECT *, sum(thickness) OVER (PARTITION BY model ORDER BY layer ROWS UNBOUNDED PRECEDING) AS zbase, lead(ai) OVER (PARTITION BY model ORDER BY layer) AS below FROM o) SELECT model, layer, zbase - thickness AS ztop, zbase, round((below - ai) / (below + ai), 6) AS reflectivity FROM n")
def q_layer_depths(spark, sf):
    o = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model"), F.col("l_linenumber").cast("int").alias("layer")).agg(F.sum("l_quantity").alias("thickness"), F.max("l_extendedprice").alias("ai"))
    return earth.reflectivity(earth.layer_tops(o)).select("model", "layer", "ztop", "zbase", r("reflectivity").alias("reflectivity"))


@query(f"WITH {L}, w AS (SELECT DISTINCT well, 7.5 AS at FROM l UNION SELECT DISTINCT well, 12.0 FROM l) SELECT w.well, CAST(w.at AS DOUBLE) AS at, round(a.val + (b.val - a.val) * (w.at - floor(w.at)), 5) AS val FROM w LEFT JOIN l a ON a.well = w.well AND a.dah = floor(w.at) LEFT JOIN l b ON b.well = w.well AND b.dah = ceil(w.at)")
def q_position_lookup(spark, sf):
    log = logs(spark, sf)
    wanted = log.select("well").distinct().select("well", F.explode(F.array(F.lit(7.5), F.lit(12.0))).alias("at"))
    return earth.at_depth(log, wanted).select("well", "at", r("val", 5).alias("val"))


@query(f"WITH {L} SELECT well, CAST(floor(dah / 4) * 4 AS DOUBLE) AS top, round(avg(val), 5) AS average, count(*) AS n FROM l GROUP BY ALL")
def q_log_upscale(spark, sf):
    return logs(spark, sf).groupBy("well", (F.floor(F.col("dah") / 4) * 4).cast("double").alias("top")).agg(r(F.avg("val"), 5).alias("average"), F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT event_id, exp(-0.5 * power((value - 20) / 10, 2)) / sqrt(2 * pi()) * 0.5 AS p1, exp(-0.5 * power((value - 50) / 15, 2)) / sqrt(2 * pi()) * 0.3 AS p2, exp(-0.5 * power((value - 90) / 8, 2)) / sqrt(2 * pi()) * 0.2 AS p3 FROM events) SELECT event_id, CAST(CASE WHEN greatest(p1, p2, p3) < 1e-20 THEN -1 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS INTEGER) AS cls, round(CASE WHEN greatest(p1, p2, p3) < 1e-20 THEN 0 ELSE (greatest(p1, p2, p3) - list_sort([p1, p2, p3])[2]) / greatest(p1, p2, p3) END, 5) AS confidence FROM p")
def q_bayes_classify(spark, sf):
    return earth.classify(load(spark, sf, "events"), [(20.0, 10.0, 0.5), (50.0, 15.0, 0.3), (90.0, 8.0, 0.2)], "value").select("event_id", "cls", r("confidence", 5).alias("confidence"))


@query()
def q_connected_components(spark, sf):
    """Parts and suppliers joined by all rows of lineitem; a recursive SQL query is too slow on whole tables."""
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("u"), (1000000000 + F.col("l_suppkey")).alias("v"))
    return graph.connected(e)


# ---- traces side by side, gathers and gaps


@query(f"WITH {T}, e AS (SELECT *, max(z_idx) OVER (PARTITION BY trace) AS last, avg(val) OVER (PARTITION BY trace) AS mean FROM t), n AS (SELECT *, min(CASE WHEN z_idx < last THEN val END) OVER (PARTITION BY trace) AS low, max(CASE WHEN z_idx < last THEN val END) OVER (PARTITION BY trace) AS high FROM e) SELECT trace, z_idx, round(val - mean, 5) AS centred, round(CASE WHEN high > low THEN (val - low) * 2 / (high - low) - 1 ELSE 0 END, 5) AS scaled FROM n")
def q_trace_normalise(spark, sf):
    return traces.normalised(trace_view(spark, sf)).select("trace", "z_idx", r("centred", 5).alias("centred"), r("scaled", 5).alias("scaled"))


@query(f"WITH {T} SELECT a.trace, round(sum(a.val * b.val) / sqrt(sum(a.val * a.val) * sum(b.val * b.val)), 6) AS correlation FROM t a JOIN t b ON b.trace = a.trace + 1 AND b.z_idx = a.z_idx GROUP BY a.trace")
def q_trace_correlation(spark, sf):
    t = trace_view(spark, sf)
    beside = t.select((F.col("trace") - 1).alias("trace"), "z_idx", F.col("val").alias("b"))
    pairs = t.select("trace", "z_idx", F.col("val").alias("a")).join(beside, ["trace", "z_idx"])
    return traces.correlation(pairs).select("trace", r("correlation").alias("correlation"))


@query(f"WITH {G}, c AS (SELECT inl, crl, z, CASE WHEN val > 40 THEN val ELSE 0 END AS val FROM g), m AS (SELECT inl, crl, min(CASE WHEN val <> 0 THEN z END) - 1 AS top FROM c GROUP BY ALL) SELECT inl, crl, min(top) OVER (PARTITION BY inl ORDER BY crl DESC ROWS UNBOUNDED PRECEDING) AS mute FROM m")
def q_gather_mutes(spark, sf):
    cells = grid(spark, sf).withColumn("val", F.when(F.col("val") > 40, F.col("val")).otherwise(0.0))
    return traces.outer_mutes(cells)


@query(f"WITH {G} SELECT a.inl, a.crl, a.z, round(median(b.val), 8) AS median, round(avg(b.val), 8) AS mean FROM g a JOIN g b ON b.z = a.z AND b.inl BETWEEN a.inl - 1 AND a.inl + 1 AND b.crl BETWEEN a.crl - 1 AND a.crl + 1 GROUP BY ALL")
def q_lateral_smooth(spark, sf):
    return traces.lateral_smooth(grid(spark, sf), 1, 1).select("inl", "crl", "z", r("median", 8).alias("median"), r("mean", 8).alias("mean"))


@query(f"WITH {G}, o AS (SELECT i, c FROM range(-2, 3) a(i), range(-2, 3) b(c) WHERE i * i + c * c BETWEEN 1 AND 4), n AS (SELECT inl + i AS inl, crl + c AS crl, z, sum(val / (i * i + c * c)) / sum(1 / (i * i + c * c)) AS filled, count(*) AS n FROM g, o GROUP BY ALL) SELECT inl, crl, z, round(filled, 8) AS filled FROM n ANTI JOIN g USING (inl, crl, z) WHERE n >= 3")
def q_inverse_distance(spark, sf):
    return traces.fill_inverse_distance(grid(spark, sf), 2, 3).select("inl", "crl", "z", r("filled", 8).alias("filled"))


@query("WITH t AS (SELECT l_returnflag AS cube, l_suppkey AS inl, l_linenumber AS crl, year(l_shipdate) AS z, CASE WHEN avg(l_quantity) > 26 THEN avg(l_extendedprice) ELSE 0 END AS val FROM lineitem GROUP BY ALL), d AS (SELECT *, max(abs(val)) OVER (PARTITION BY cube, inl, crl) > 0 AS live FROM t), e AS (SELECT *, bool_or(live) OVER (PARTITION BY inl, crl) AS any_live FROM d) SELECT inl, crl, CAST(z AS INTEGER) AS z, round(avg(val), 7) AS val FROM e WHERE live OR NOT any_live GROUP BY ALL")
def q_merge_stack(spark, sf):
    level = F.when(F.avg("l_quantity") > 26, F.avg("l_extendedprice")).otherwise(0.0)
    cubes = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("cube"), F.col("l_suppkey").alias("inl"), F.col("l_linenumber").alias("crl"), F.year("l_shipdate").alias("z")).agg(level.alias("val"))
    return traces.merge_stack(cubes).select("inl", "crl", "z", r("val", 7).alias("val"))


# ---- sets, sorting, windows of time


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def q_set_union(spark, sf):
    return load(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).union(load(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def q_set_intersect(spark, sf):
    return load(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).intersect(load(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def q_set_except(spark, sf):
    return load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")).subtract(load(spark, sf, "orders").where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT min(event_id) AS first_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type, day")
def q_tumbling_window(spark, sf):
    w = F.window("ts", "1 day")
    return load(spark, sf, "events").groupBy("event_type", w.alias("w")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total")).select("first_id", "event_type", F.col("w.start").alias("day"), "n", "total")


@query("WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s) SELECT user_id, min(ts) AS began, count(*) AS n FROM n GROUP BY user_id, sid")
def q_session_window(spark, sf):
    return load(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("n")).select("user_id", "began", "n")
