"""Filters and spectra of traces (trace, z_idx, val): sums over a fixed gate, all of them window expressions.

A kernel is {offset: weight}; the sample at z_idx + offset counts with the weight. Samples beyond the ends of a trace count
as 0, except where a gate is said to be required: then samples with an incomplete gate are left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from terrane.operators.traces import along, gate


def sample(offset: int, value: Column | None = None) -> Column:
    """The sample at an offset; 0 beyond the ends."""
    value = F.col("val") if value is None else value
    return F.coalesce((F.lead(value, offset) if offset > 0 else F.lag(value, -offset)).over(along()), F.lit(0.0)) if offset else F.coalesce(value, F.lit(0.0))


def kernel_sum(kernel: dict[int, float], value: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, [sample(k, value) * F.lit(float(w)) for k, w in sorted(kernel.items()) if w])


# ---- tapers and kernels

#: Tapers on |x| <= 1 (0 beyond), as functions of x: cosine series, by name. Fixed values.
TAPERS = {
    "hanning": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "flattop": (1 / 4.64, 1.93 / 4.64, 1.29 / 4.64, 0.388 / 4.64, 0.032 / 4.64),
}


def taper(name: str, x: Column) -> Column:
    """box, bartlett or one of TAPERS at x."""
    if name == "box":
        inside = F.lit(1.0)
    elif name == "bartlett":
        inside = 1 - F.abs(x)
    else:
        inside = reduce(lambda a, b: a + b, [F.lit(c) * F.cos(F.lit(math.pi * i) * x) for i, c in enumerate(TAPERS[name])])
    return F.when(F.abs(x) <= 1, inside).otherwise(0.0)


def taper_at(name: str, x: float) -> float:
    return sum(c * math.cos(math.pi * i * x) for i, c in enumerate(TAPERS[name])) if abs(x) <= 1 else 0.0


def hilbert_kernel(half: int) -> dict[int, float]:
    """2 / (pi k) at odd distances, Hamming-tapered; the result is the quadrature trace."""
    return {-k: 2 / (math.pi * k) * taper_at("hamming", k / (half + 1)) for k in range(-half, half + 1) if k % 2}


def band_kernel(low: float, high: float, half: int) -> dict[int, float]:
    """Passes frequencies from low to high (cycles a sample; low 0: a low pass, high 0.5: a high pass): differences of sinc
    functions, Hanning-tapered."""
    sinc = lambda f, k: 2 * f if k == 0 else math.sin(2 * math.pi * f * k) / (math.pi * k)
    return {k: (sinc(high, k) - sinc(low, k)) * taper_at("hanning", k / (half + 1)) for k in range(-half, half + 1)}


def ricker_kernel(frequency: float, half: int) -> dict[int, float]:
    arg = lambda k: (math.pi * frequency * k) ** 2
    return {k: (1 - 2 * arg(k)) * math.exp(-arg(k)) for k in range(-half, half + 1)}


def mexican_hat_kernel(scale: float, half: int) -> dict[int, float]:
    """The continuous wavelet transform at one scale is the sum with this kernel."""
    return {k: (1 - (k / scale) ** 2) * math.exp(-((k / scale) ** 2) / 2) / math.sqrt(scale) for k in range(-half, half + 1)}


# ---- spectra


def spectra(traces: DataFrame, half: int, bins: list[int]) -> DataFrame:
    """a<k>: amplitude at frequency k / n of the n = 2 * half + 1 samples around each one. The gate is required."""
    n = 2 * half + 1
    out = {}
    for k in bins:
        turn = 2 * math.pi * k / n
        re = kernel_sum({d: math.cos(turn * d) for d in range(-half, half + 1)})
        im = kernel_sum({d: math.sin(turn * d) for d in range(-half, half + 1)})
        out |= {f"re{k}": re, f"im{k}": im}
    rows = traces.withColumns(out | {"n": F.count(F.lit(1)).over(gate(-half, half))}).where(F.col("n") == n)
    amplitudes = [F.sqrt(F.col(f"re{k}") ** 2 + F.col(f"im{k}") ** 2).alias(f"a{k}") for k in bins]
    return rows.select(*traces.columns, *amplitudes)


def dominant(spectrum: DataFrame, bins: list[int], n: int) -> DataFrame:
    """Dominant frequency (the lowest on a tie), mean frequency weighted by amplitude, and the greatest amplitude."""
    best = F.greatest(*[F.col(f"a{k}") for k in bins])
    first = F.coalesce(*[F.when(F.col(f"a{k}") == best, F.lit(k / n)) for k in bins])
    total = sum((F.col(f"a{k}") for k in bins), F.lit(0.0))
    moment = sum((F.col(f"a{k}") * (k / n) for k in bins), F.lit(0.0))
    return spectrum.withColumns({"dominant": first, "average": moment / F.nullif(total, F.lit(0.0)), "amplitude": best})


def haar(traces: DataFrame, levels: int) -> DataFrame:
    """trace, level, k, detail: Haar coefficients, (first half - second half) / sqrt(2^level) of each whole block."""
    rows = traces.select("trace", "z_idx", "val", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    rows = rows.withColumn("size", F.pow(F.lit(2), F.col("level")).cast("int"))
    sign = F.when(F.col("z_idx") % F.col("size") < F.col("size") / 2, F.col("val")).otherwise(-F.col("val"))
    blocks = rows.groupBy("trace", "level", "size", F.floor(F.col("z_idx") / F.col("size")).alias("k")).agg(F.sum(sign).alias("d"), F.count(F.lit(1)).alias("n"))
    return blocks.where("n = size").select("trace", "level", "k", (F.col("d") / F.sqrt("size")).alias("detail"))


def autocorrelation(traces: DataFrame, lags: int) -> DataFrame:
    """trace, r: sums of x(z) x(z + k), k from 0 to lags."""
    rows = traces.select("trace", *[(F.col("val") * sample(k)).alias(f"p{k}") for k in range(lags + 1)])
    return rows.groupBy("trace").agg(F.array(*[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(lags + 1)]).alias("r"))


def prediction_filters(correlations: DataFrame, gap: int, length: int, noise: float) -> DataFrame:
    """Adds filter: the `length` weights that predict a sample from those `gap` and more before it (Toeplitz equations, the
    diagonal raised by the share `noise`); zeros for a dead trace."""

    @pandas_udf("array<double>")
    def solve(r: pd.Series) -> pd.Series:
        if not len(r):
            return pd.Series([], dtype=object)
        r = np.stack(r.to_numpy())
        dead = r[:, 0] <= 0
        away = np.abs(np.arange(length)[:, None] - np.arange(length)[None, :])
        matrix = r[:, away] + noise * r[:, :1, None] * np.eye(length)
        matrix[dead] = np.eye(length)
        wanted = np.where(dead[:, None], 0.0, r[:, gap : gap + length])
        return pd.Series(list(np.linalg.solve(matrix, wanted[:, :, None])[:, :, 0]))

    return correlations.withColumn("filter", solve("r"))


def gap_decon(traces: DataFrame, gap: int, length: int, noise: float) -> DataFrame:
    """traces with decon: the error of predicting each sample; one small filter for each trace is joined to it."""
    rows = traces.withColumn("past", F.array(*[sample(-gap - k) for k in range(length)]))
    filters = prediction_filters(autocorrelation(traces, gap + length - 1), gap, length, noise).select("trace", "filter")
    error = F.aggregate(F.zip_with("past", "filter", lambda a, b: a * b), F.col("val"), lambda s, x: s - x)
    return rows.join(filters, "trace").withColumn("decon", error).drop("past", "filter")


def unwrapped(phase: Column) -> Column:
    """Phase without jumps: the running sum of steps brought into (-pi, pi]; `phase` is a column computed before."""
    step = phase - F.lag(phase).over(along())
    turns = F.ceil((step - math.pi) / (2 * math.pi))
    return F.coalesce(step - turns * (2 * math.pi), phase)


def peaks(traces: DataFrame) -> DataFrame:
    """before, after: distance from each sample to the last peak before it and the next one after it (undefined if none).
    A peak is above the sample before it and not below the one after it."""
    w = along()
    peak = (F.col("val") > F.lag("val").over(w)) & (F.col("val") >= F.lead("val").over(w))
    rows = traces.withColumn("peak", F.when(peak, F.col("z_idx")))
    last = F.max("peak").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the next peak, seen from the other end, is the last one before
    back = F.min("peak").over(Window.partitionBy("trace").orderBy(F.desc("z_idx")).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"before": F.col("z_idx") - last, "after": back - F.col("z_idx")}).drop("peak")


def gate_scaled(traces: DataFrame, size: int) -> DataFrame:
    """scaled: samples over the RMS of their gate; gates of `size` samples follow each other; a gate of zeros stays."""
    w = Window.partitionBy("trace", F.floor(F.col("z_idx") / size))
    rms = F.sqrt(F.avg(F.col("val") * F.col("val")).over(w))
    return traces.withColumn("scaled", F.when(rms > 0, F.col("val") / rms).otherwise(F.col("val")))


def shifted(traces: DataFrame, by: float) -> DataFrame:
    """shifted: the value at z_idx + by, linear between samples; both are required."""
    low = math.floor(by)
    part = by - low
    at = lambda k: (F.lead("val", k) if k >= 0 else F.lag("val", -k)).over(along())
    return traces.withColumn("shifted", at(low) if part == 0 else at(low) * (1 - part) + at(low + 1) * part)


def resampled(traces: DataFrame, delta: Column) -> DataFrame:
    """resampled: the trace's value at z_idx + delta, linear between samples, undefined beyond its ends. Samples meet by
    equality of (trace, z_idx), so a shift that differs from sample to sample costs two joins and pairs nothing."""
    want = traces.withColumn("at", F.col("z_idx") + delta).withColumn("low", F.floor("at"))
    a = traces.select("trace", F.col("z_idx").cast("long").alias("low"), F.col("val").alias("v0"))
    b = traces.select("trace", (F.col("z_idx") - 1).cast("long").alias("low"), F.col("val").alias("v1"))
    part = F.col("at") - F.col("low")
    value = F.when(part == 0, F.col("v0")).otherwise(F.col("v0") * (1 - part) + F.col("v1") * part)
    return want.join(a, ["trace", "low"], "left").join(b, ["trace", "low"], "left").withColumn("resampled", value).drop("v0", "v1", "low")
