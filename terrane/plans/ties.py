"""Queries of wavelets, ties and spectral filters over events as traces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import bending, wavelets
from terrane.plans.registry import query, r
from terrane.plans.views import T, load
from terrane.plans.views import traces as trace_view


def _traces(spark, sf):
    """events as a trace a user, samples by time."""
    rows = load(spark, sf, "events").groupBy(F.col("user_id").alias("trace")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select("trace", F.col("s.value").alias("samples"))


def _listed(df, name, digits=6):
    return df.select("trace", F.posexplode(name).alias("z_idx", "v")).select("trace", "z_idx", r(F.col("v"), digits).alias(name))


#: Lag sums, their spectrum and the wavelet of 17 samples.
@query(f"""WITH {T}, a AS (SELECT lag, coalesce(sum(a.val * b.val), 0) * (1 - lag / 9.0) AS r FROM range(0, 9) x(lag), t a JOIN t b ON a.trace = b.trace WHERE b.z_idx = a.z_idx + lag GROUP BY lag),
s AS (SELECT k, sqrt(greatest(sum(CASE WHEN lag = 0 THEN r ELSE 2 * r * cos(2 * pi() * k * lag / 17) END), 0)) AS amp FROM a, range(0, 9) y(k) GROUP BY k),
w AS (SELECT u - 8 AS t, sum(CASE WHEN k = 0 THEN amp ELSE 2 * amp * cos(2 * pi() * k * (u - 8) / 17) END) / 17 AS w FROM s, range(0, 17) z(u) GROUP BY u)
SELECT t, round(w / max(abs(w)) OVER (), 6) AS amplitude FROM w""")
def q_wavelet_extraction(spark, sf):
    return wavelets.extract_wavelet(_traces(spark, sf), 8).select("t", r("amplitude").alias("amplitude"))


@query()
def q_well_tie(spark, sf):
    """Every trace's own reflectivity, as of impedances 1000 + value, tied back to the trace."""
    rows = _traces(spark, sf)
    above = F.slice("samples", 1, F.size("samples") - 1)
    rows = rows.where(F.size("samples") > 1).withColumn("reflectivity", F.zip_with(above, F.slice("samples", 2, F.size("samples") - 1), lambda a, b: F.try_divide(b - a, a + b + 2000)))
    t = np.arange(-6, 7) * np.pi * 0.15
    return wavelets.tie(rows.withColumnRenamed("trace", "well"), (1 - 2 * t * t) * np.exp(-t * t), 8, [0.9, 1.0, 1.1])


_SPECTRA = f"""{T}, n AS (SELECT trace, count(*) AS n FROM t GROUP BY 1), k AS (SELECT trace, n, unnest(range(0, n // 2 + 1)) AS k FROM n),
s AS (SELECT k.trace, k.n, k.k, k.k / CAST(k.n AS DOUBLE) AS f, CASE WHEN k.k = 0 OR 2 * k.k = k.n THEN 1 ELSE 2 END AS sides, sum(coalesce(val, 0) * cos(2 * pi() * k.k * z_idx / k.n)) AS re, -sum(coalesce(val, 0) * sin(2 * pi() * k.k * z_idx / k.n)) AS im FROM k JOIN t ON k.trace = t.trace GROUP BY ALL)"""


@query(f"""WITH {_SPECTRA}, w AS (SELECT *, (0.5 - 0.5 * cos(pi() * greatest(0, least(1, (f - 0.02) / 0.04)))) * (0.5 - 0.5 * cos(pi() * greatest(0, least(1, (0.3 - f) / 0.1)))) AS weight FROM s)
SELECT t.trace, t.z_idx, round(sum(weight * sides * (re * cos(2 * pi() * k * z_idx / n) - im * sin(2 * pi() * k * z_idx / n))) / any_value(n), 6) AS filtered FROM w JOIN t ON w.trace = t.trace GROUP BY 1, 2""")
def q_fft_filter(spark, sf):
    return _listed(wavelets.fft_filter(_traces(spark, sf), [0.02, 0.06, 0.2, 0.3]), "filtered")


@query()
def q_butterworth(spark, sf):
    return _listed(wavelets.butterworth(_traces(spark, sf), 4, 0.12), "filtered")


@query(f"""WITH {_SPECTRA}, z AS (SELECT trace, CAST(unnest(range(0, 4 * n)) AS INTEGER) AS z_idx FROM n)
SELECT z.trace, z.z_idx, round(sum(sides * (re * cos(pi() * k * z_idx / (2 * n)) - im * sin(pi() * k * z_idx / (2 * n)))) / any_value(n), 6) AS samples FROM s JOIN z ON s.trace = z.trace GROUP BY 1, 2""")
def q_fourier_interpolation(spark, sf):
    return _listed(wavelets.interpolate_spectrum(_traces(spark, sf), 4), "samples")


_KERNEL = np.exp(-((np.arange(-6, 7) / 3.0) ** 2))


@query(f"WITH {T} SELECT a.trace, a.z_idx, round(sum(coalesce(b.val, 0) * exp(-power((a.z_idx - b.z_idx) / 3.0, 2))), 6) AS filtered FROM t a JOIN t b ON a.trace = b.trace AND b.z_idx BETWEEN a.z_idx - 6 AND a.z_idx + 6 GROUP BY ALL")
def q_convolve_blocks(spark, sf):
    return wavelets.convolve_blocks(trace_view(spark, sf).select("trace", "z_idx", "val"), _KERNEL).select("trace", "z_idx", r("filtered").alias("filtered"))


@query()
def q_empirical_modes(spark, sf):
    modes = bending.empirical_modes(_traces(spark, sf), 3, 0.05, 10)
    return modes.select("trace", "mode", F.posexplode("samples").alias("z_idx", "v")).select("trace", "mode", "z_idx", r(F.col("v"), 4).alias("val"))


@query()
def q_bending_rays(spark, sf):
    q = F.max("l_quantity")
    layers = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("layer")).agg(F.sum("l_quantity").alias("thickness"), (1500 + 30.0 * q).alias("vp"))
    return bending.bending_rays(layers, [0.0, 50.0, 400.0]).select("model", "layer", "offset", r("p", 10).alias("p"), r("twt", 8).alias("twt"), r("angle").alias("angle"))
