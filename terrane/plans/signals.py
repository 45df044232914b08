"""Queries of filters, spectra and transforms along traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import signals, traces
from terrane.plans.registry import query, r
from terrane.plans.views import T, load
from terrane.plans.views import traces as trace_view


def _sum(weight: str, half: int, name: str, digits: int = 4, rows: str = T, table: str = "t") -> str:
    """SQL of a kernel sum; in weight, d is the distance of the other sample from this one."""
    pairs = f"SELECT a.trace, a.z_idx, b.val, CAST(b.z_idx - a.z_idx AS DOUBLE) AS d FROM {table} a JOIN {table} b ON a.trace = b.trace AND b.z_idx BETWEEN a.z_idx - {half} AND a.z_idx + {half}"
    return f"WITH {rows}, p AS ({pairs}) SELECT trace, z_idx, round(sum(coalesce(val, 0) * ({weight})), {digits}) AS {name} FROM p GROUP BY trace, z_idx"


def _applied(spark, sf, kernel, name, digits=4):
    return trace_view(spark, sf).select("trace", "z_idx", r(signals.kernel_sum(kernel), digits).alias(name))


@query(_sum("CASE WHEN d % 2 <> 0 THEN -2 / (pi() * d) * (0.54 + 0.46 * cos(pi() * d / 16)) ELSE 0 END", 15, "quadrature"))
def q_hilbert(spark, sf):
    return _applied(spark, sf, signals.hilbert_kernel(15), "quadrature")


@query(_sum("(CASE WHEN d = 0 THEN 0.3 ELSE (sin(0.4 * pi() * d) - sin(0.1 * pi() * d)) / (pi() * d) END) * (0.5 + 0.5 * cos(pi() * d / 13))", 12, "filtered"))
def q_freq_filter(spark, sf):
    return _applied(spark, sf, signals.band_kernel(0.05, 0.2, 12), "filtered")


@query(_sum("(1 - d * d / 9) * exp(-d * d / 18) / sqrt(3)", 12, "coefficient"))
def q_cwt_mexican_hat(spark, sf):
    return _applied(spark, sf, signals.mexican_hat_kernel(3.0, 12), "coefficient")


_REFLECTIVITY = f"{T}, f AS (SELECT trace, z_idx, (n - val) / nullif(n + val, 0) AS val FROM (SELECT *, lead(val) OVER (PARTITION BY trace ORDER BY z_idx) AS n FROM t))"


@query(_sum("(1 - 2 * power(pi() * 0.1 * d, 2)) * exp(-power(pi() * 0.1 * d, 2))", 10, "synthetic", 6, _REFLECTIVITY, "f"))
def q_synthetic_trace(spark, sf):
    below = F.lead("val").over(traces.along())
    rows = trace_view(spark, sf).withColumn("reflectivity", (below - F.col("val")) / F.nullif(below + F.col("val"), F.lit(0.0)))
    return rows.select("trace", "z_idx", r(signals.kernel_sum(signals.ricker_kernel(0.1, 10), F.col("reflectivity"))).alias("synthetic"))


_SPECTRUM = f"""WITH {T}, d AS (SELECT a.trace, a.z_idx, k, sum(b.val * cos(2 * pi() * k * (b.z_idx - a.z_idx) / 17)) AS re, sum(b.val * sin(2 * pi() * k * (b.z_idx - a.z_idx) / 17)) AS im
FROM t a JOIN t b ON a.trace = b.trace AND b.z_idx BETWEEN a.z_idx - 8 AND a.z_idx + 8 CROSS JOIN range(1, 9) x(k) GROUP BY ALL HAVING count(*) = 17), s AS (SELECT trace, z_idx, k, sqrt(re * re + im * im) AS a FROM d)"""


@query(_SPECTRUM + " SELECT trace, z_idx, " + ", ".join(f"round(max(a) FILTER (k = {k}), 4) AS a{k}" for k in (1, 2, 3, 4)) + " FROM s GROUP BY ALL")
def q_spec_decomp(spark, sf):
    got = signals.spectra(trace_view(spark, sf), 8, [1, 2, 3, 4])
    return got.select("trace", "z_idx", *[r(f"a{k}", 4).alias(f"a{k}") for k in (1, 2, 3, 4)])


@query(_SPECTRUM + " SELECT trace, z_idx, round(arg_max(k, a) / 17, 6) AS dominant, round(sum(k * a) / sum(a) / 17, 6) AS average, round(max(a), 4) AS amplitude FROM s GROUP BY ALL")
def q_frequency(spark, sf):
    bins = list(range(1, 9))
    got = signals.dominant(signals.spectra(trace_view(spark, sf), 8, bins), bins, 17)
    return got.select("trace", "z_idx", r("dominant").alias("dominant"), r("average").alias("average"), r("amplitude", 4).alias("amplitude"))


@query("SELECT p_partkey, " + ", ".join(f"round(CASE WHEN abs(x) <= 1 THEN {w} ELSE 0 END, 9) + CAST(0 AS DOUBLE) AS {n}" for n, w in {
    "box": "CAST(1 AS DOUBLE)", "bartlett": "1 - abs(x)", "hanning": "0.5 + 0.5 * cos(pi() * x)", "hamming": "0.54 + 0.46 * cos(pi() * x)",
    "blackman": "0.42 + 0.5 * cos(pi() * x) + 0.08 * cos(2 * pi() * x)",
    "flattop": "(1 + 1.93 * cos(pi() * x) + 1.29 * cos(2 * pi() * x) + 0.388 * cos(3 * pi() * x) + 0.032 * cos(4 * pi() * x)) / 4.64"}.items()) + " FROM (SELECT p_partkey, (p_size - 25) / 20 AS x FROM part)")
def q_window_functions(spark, sf):
    x = (F.col("p_size") - 25) / 20
    return load(spark, sf, "part").select("p_partkey", *[(r(signals.taper(n, x), 9) + 0.0).alias(n) for n in ("box", "bartlett", *signals.TAPERS)])


@query(f"WITH {T}, b AS (SELECT trace, CAST(level AS INTEGER) AS level, CAST(z_idx // (1 << level) AS BIGINT) AS k, sum(CASE WHEN z_idx % (1 << level) < (1 << level) / 2 THEN val ELSE -val END) AS d, count(*) AS n FROM t CROSS JOIN range(1, 4) x(level) GROUP BY ALL) SELECT trace, level, k, round(d / sqrt(1 << level), 5) AS detail FROM b WHERE n = (1 << level)")
def q_dwt_haar(spark, sf):
    return signals.haar(trace_view(spark, sf), 3).select("trace", "level", "k", r("detail", 5).alias("detail"))


_LAGS = "a AS (SELECT trace, sum(val * val) AS r0, " + ", ".join(f"coalesce(sum(val * n{k}), 0) AS r{k}" for k in (1, 2, 3)) + " FROM (SELECT *, " + ", ".join(f"lead(val, {k}) OVER (PARTITION BY trace ORDER BY z_idx) AS n{k}" for k in (1, 2, 3)) + " FROM t) GROUP BY trace)"


@query(f"WITH {T}, {_LAGS} SELECT trace, round(r0, 2) AS r0, round(r1, 2) AS r1, round(r2, 2) AS r2, round(r3, 2) AS r3 FROM a")
def q_autocorrelation(spark, sf):
    got = signals.autocorrelation(trace_view(spark, sf), 3)
    return got.select("trace", *[r(F.col("r")[k], 2).alias(f"r{k}") for k in range(4)])


@query(f"""WITH {T}, {_LAGS}, f AS (SELECT trace, (r1 * r0 * 1.01 - r2 * r1) / d AS f0, (r2 * r0 * 1.01 - r1 * r1) / d AS f1 FROM (SELECT *, r0 * 1.01 * r0 * 1.01 - r1 * r1 AS d FROM a)),
s AS (SELECT *, coalesce(lag(val) OVER w, 0) AS b1, coalesce(lag(val, 2) OVER w, 0) AS b2 FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx))
SELECT s.trace, z_idx, round(val - f0 * b1 - f1 * b2, 4) AS decon FROM s JOIN f ON s.trace = f.trace""")
def q_gap_decon(spark, sf):
    return signals.gap_decon(trace_view(spark, sf), 1, 2, 0.01).select("trace", "z_idx", r("decon", 4).alias("decon"))


@query(f"""WITH {T}, p AS (SELECT trace, z_idx, atan2(val - 50, coalesce(lag(val) OVER w, 0) - 50) AS ph FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)),
s AS (SELECT trace, z_idx, ph, ph - lag(ph) OVER w AS d FROM p WINDOW w AS (PARTITION BY trace ORDER BY z_idx))
SELECT trace, z_idx, round(sum(coalesce(d - ceil((d - pi()) / (2 * pi())) * 2 * pi(), ph)) OVER (PARTITION BY trace ORDER BY z_idx), 4) AS phase FROM s""")
def q_phase_unwrap(spark, sf):
    rows = trace_view(spark, sf).select("trace", "z_idx", F.atan2(F.col("val") - 50, signals.sample(-1) - 50).alias("ph"))
    rows = rows.withColumn("step", signals.unwrapped(F.col("ph")))
    return rows.select("trace", "z_idx", r(F.sum("step").over(traces.along()), 4).alias("phase"))


@query(f"""WITH {T}, k AS (SELECT trace, z_idx, CASE WHEN val > lag(val) OVER w AND val >= lead(val) OVER w THEN z_idx END AS p FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx))
SELECT trace, z_idx, CAST(z_idx - max(p) OVER (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS before, CAST(min(p) OVER (PARTITION BY trace ORDER BY z_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - z_idx AS DOUBLE) AS after FROM k""")
def q_event_distance(spark, sf):
    return signals.peaks(trace_view(spark, sf)).select("trace", "z_idx", F.col("before").cast("double"), F.col("after").cast("double"))


@query(f"WITH {T}, g AS (SELECT *, sqrt(avg(val * val) OVER (PARTITION BY trace, z_idx // 16)) AS l FROM t) SELECT trace, z_idx, round(CASE WHEN l > 0 THEN val / l ELSE val END, 6) AS scaled FROM g")
def q_scaling_window(spark, sf):
    return signals.gate_scaled(trace_view(spark, sf), 16).select("trace", "z_idx", r("scaled").alias("scaled"))


@query(f"WITH {T} SELECT trace, z_idx, round(lead(val) OVER w * 0.6 + lead(val, 2) OVER w * 0.4, 5) AS shifted FROM t WINDOW w AS (PARTITION BY trace ORDER BY z_idx)")
def q_shift_interpolated(spark, sf):
    return signals.shifted(trace_view(spark, sf), 1.4).select("trace", "z_idx", r("shifted", 5).alias("shifted"))


@query(f"""WITH {T}, w AS (SELECT trace, z_idx, z_idx + (z_idx % 5 - 2) * 0.25 AS pos FROM t)
SELECT w.trace, w.z_idx, round(CASE WHEN pos = floor(pos) THEN a.val ELSE a.val * (1 - (pos - floor(pos))) + b.val * (pos - floor(pos)) END, 5) AS resampled
FROM w LEFT JOIN t a ON a.trace = w.trace AND a.z_idx = floor(pos) LEFT JOIN t b ON b.trace = w.trace AND b.z_idx = floor(pos) + 1""")
def q_delta_resample(spark, sf):
    got = signals.resampled(trace_view(spark, sf), (F.col("z_idx") % 5 - 2) * 0.25)
    return got.select("trace", "z_idx", r("resampled", 5).alias("resampled"))
