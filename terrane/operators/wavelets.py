"""Wavelets from traces, ties of wells to traces, and filters by spectrum and by poles.

Traces are rows with an array of samples; where a trace may be too long for one row, they are samples (trace, z_idx, val).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of samples as rows, 0 for null and beyond the end, and their lengths."""
    sizes = np.array([len(s) if s.is_valid else 0 for s in column], np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for row, s in zip(out, column):
        if s.is_valid:
            values = s.values.to_numpy(zero_copy_only=False).astype(float)
            row[: len(values)] = np.nan_to_num(values)
    return out, sizes


def correlations(rows: DataFrame, one: str, other: str, lags: int) -> np.ndarray:
    """Sums over all rows of one[t] * other[t + lag], lag 0 to lags. A row's sums are made where it lies; what meets are
    lags + 1 numbers a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(lags + 1)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                (a, _), (b, _) = _matrix(batch.column(0).slice(k, 256)), _matrix(batch.column(1).slice(k, 256))
                n = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))
                total += [float((a[:, : n - lag] * b[:, lag:]).sum()) if lag < n else 0.0 for lag in range(lags + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lags + 1)), pa.array(total)], names=["lag", "sum"])

    sums = rows.select(F.col(one).alias("a"), F.col(other).alias("b")).mapInArrow(run, "lag long, sum double").groupBy("lag").agg(F.sum("sum").alias("sum")).collect()
    out = np.zeros(lags + 1)
    for r in sums:
        out[r.lag] = r.sum
    return out


def wavelet_of(autocorrelation: np.ndarray, phase: float = 0.0) -> np.ndarray:
    """The wavelet, 2 * lags + 1 samples around its middle, whose amplitude spectrum is the root of that of the Bartlett-tapered
    autocorrelation, turned by `phase` degrees, with its greatest amplitude 1 (zeros stay zeros)."""
    lags = len(autocorrelation) - 1
    n = 2 * lags + 1
    tapered = autocorrelation * (1 - np.arange(lags + 1) / (lags + 1))
    amplitude = np.sqrt(np.maximum(np.fft.rfft(np.concatenate([tapered, tapered[:0:-1]])).real, 0))
    turned = amplitude * np.exp(1j * np.radians(phase) * (np.arange(len(amplitude)) > 0))
    out = np.fft.fftshift(np.fft.irfft(turned, n))
    most = np.abs(out).max(initial=0.0)
    return out / most if most > 0 else out


def extract_wavelet(traces: DataFrame, lags: int, phase: float = 0.0) -> DataFrame:
    """t (-lags to lags) and amplitude of the wavelet of traces (samples), see wavelet_of. Null samples count as 0, null traces
    as none; no traces give zeros."""
    w = wavelet_of(correlations(traces, "samples", "samples", lags), phase)
    return traces.sparkSession.createDataFrame([(t - lags, float(x)) for t, x in enumerate(w)], "t long, amplitude double")


def matching_wavelet(pairs: DataFrame, lags: int, noise: float = 1e-3) -> np.ndarray:
    """The wavelet of -lags to lags that makes reflectivity into samples best, in least squares over all rows (reflectivity,
    samples): a Toeplitz system of correlations, with `noise` of its diagonal added."""
    auto = correlations(pairs, "reflectivity", "reflectivity", 2 * lags)
    ahead, behind = correlations(pairs, "reflectivity", "samples", lags), correlations(pairs, "samples", "reflectivity", lags)
    n = 2 * lags + 1
    system = auto[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))] + np.eye(n) * (noise * auto[0] + 1e-300)
    return np.linalg.solve(system, np.concatenate([behind[:0:-1], ahead]))


def tie(wells: DataFrame, wavelet: np.ndarray, reach: int, stretches: list[float]) -> DataFrame:
    """well, shift, stretch and correlation of wells (well, reflectivity, samples): how the synthetic, reflectivity times
    wavelet, lies best on the samples, over shifts of -reach to reach samples and the stretches around its start.

    The sample at z of the stretched and shifted synthetic is that at (z - shift) / stretch, linear between samples, 0
    beyond. Ties go to the stretch nearest to 1, then to the smaller shift, then upwards. Null samples count as 0; a well
    whose samples or synthetic are flat has nulls; null lists are empty ones.
    """
    half = len(wavelet) // 2
    order = sorted(stretches, key=lambda s: (abs(s - 1), s))
    shifts = sorted(range(-reach, reach + 1), key=lambda k: (abs(k), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, s in zip(batch.column(1), batch.column(2)):
                (r, n), (s, m) = _matrix(pa.array([r.as_py()], pa.list_(pa.float64()))), _matrix(pa.array([s.as_py()], pa.list_(pa.float64())))
                made, seen, best = np.convolve(r[0], wavelet)[half : half + int(n[0])] if n[0] else np.zeros(0), s[0], (None, None, None)
                z = np.arange(int(m[0]))
                for stretch in order if n[0] and m[0] else ():
                    for shift in shifts:
                        moved = np.interp((z - shift) / stretch, np.arange(len(made)), made, 0.0, 0.0)
                        a, b = moved - moved.mean(), seen - seen.mean()
                        size = float((a @ a) * (b @ b))
                        like = round(float(a @ b) / size**0.5, 10) if size > 1e-300 else None
                        if like is not None and (best[2] is None or like > best[2]):
                            best = (shift, stretch, like)
                rows.append(best)
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64())))], names=["well", "shift", "stretch", "correlation"])

    kind = wells.schema["well"].dataType.simpleString()
    return wells.select("well", "reflectivity", "samples").mapInArrow(run, f"well {kind}, shift long, stretch double, correlation double")


def pass_band(n: int, corners: list[float]) -> np.ndarray:
    """The weight of each frequency k / n: 0 up to the first corner, 1 between the middle two, 0 from the last on, cosines
    between. Corners rise; in cycles a sample."""
    f1, f2, f3, f4 = corners
    f = np.fft.rfftfreq(n)
    rise = np.clip((f - f1) / (f2 - f1), 0, 1) if f2 > f1 else (f >= f1).astype(float)
    fall = np.clip((f4 - f) / (f4 - f3), 0, 1) if f4 > f3 else (f <= f4).astype(float)
    return (0.5 - 0.5 * np.cos(np.pi * rise)) * (0.5 - 0.5 * np.cos(np.pi * fall))


def _each(traces: DataFrame, f, name: str) -> DataFrame:
    """trace and what f makes of each array of samples."""
    kind = traces.schema["trace"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if not s.is_valid else f(np.nan_to_num(s.values.to_numpy(zero_copy_only=False).astype(float))) if len(s) else np.zeros(0) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["trace", name])

    return traces.select("trace", "samples").mapInArrow(run, f"trace {kind}, {name} array<double>")


def fft_filter(traces: DataFrame, corners: list[float]) -> DataFrame:
    """trace and filtered: samples times pass_band in the frequencies of the whole trace. Null samples count as 0."""
    return _each(traces, lambda x: np.fft.irfft(np.fft.rfft(x) * pass_band(len(x), corners), len(x)), "filtered")


def sections(order: int, cut: float, high: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """A Butterworth filter of even order as second-order sections (numerator, denominator) by its poles, bilinear; cut in
    cycles a sample."""
    if order < 2 or order % 2 or not 0 < cut < 0.5:
        raise ValueError("an even order, and a cut between 0 and half a cycle a sample")
    k, out = np.tan(np.pi * cut), []
    for m in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * m + 1) / (2 * order)))
        d = 1 + k / q + k * k
        top = np.array([1.0, -2.0, 1.0]) if high else k * k * np.array([1.0, 2.0, 1.0])
        out.append((top / d, np.array([1.0, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d])))
    return out


def _recursed(x: np.ndarray, parts) -> np.ndarray:
    for b, a in parts:
        y, s1, s2 = np.empty_like(x), 0.0, 0.0
        for t, v in enumerate(x.tolist()):
            w = b[0] * v + s1
            s1, s2 = b[1] * v - a[1] * w + s2, b[2] * v - a[2] * w
            y[t] = w
        x = y
    return x


def butterworth(traces: DataFrame, order: int, cut: float, high: bool = False) -> DataFrame:
    """trace and filtered: samples through a Butterworth filter forwards and then backwards, so without phase. Null samples
    count as 0; rest before the first and behind the last."""
    parts = sections(order, cut, high)
    return _each(traces, lambda x: _recursed(_recursed(x, parts)[::-1], parts)[::-1], "filtered")


def interpolate_spectrum(traces: DataFrame, factor: int) -> DataFrame:
    """trace and samples at `factor` times the rate: those between the given ones by the trace's own frequencies, as if it went
    round. What is at the highest frequency of an even length is shared between both signs."""

    def f(x: np.ndarray) -> np.ndarray:
        n = len(x)
        spectrum = np.fft.rfft(x)
        if n % 2 == 0 and factor > 1:
            spectrum[-1] /= 2
        return np.fft.irfft(spectrum, n * factor) * factor

    return _each(traces, f, "samples")


def convolve_blocks(samples: DataFrame, kernel: np.ndarray, block: int = 4096) -> DataFrame:
    """trace, z_idx, filtered: samples (trace, z_idx from 0 without gaps, val) with the kernel, whose middle lies at its own
    sample, turned over; 0 beyond the ends and for null.

    Traces are cut in blocks of z, each with the samples around that the kernel reaches: no task holds a trace, however
    long, and nothing is ordered but within blocks.
    """
    half = len(kernel) // 2
    rest = len(kernel) - 1 - half
    z = F.col("z_idx")
    near = F.array_distinct(F.array(F.floor((z - half) / block), F.floor(z / block), F.floor((z + rest) / block))) if max(half, rest) <= block else F.sequence(F.floor((z - half) / block), F.floor((z + rest) / block))
    dealt = samples.select("trace", z.cast("long").alias("z_idx"), F.col("val").cast("double").alias("val"), F.explode(near).alias("block"))
    kind = samples.schema["trace"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        b = table["block"][0].as_py()
        at, value = table["z_idx"].to_numpy(), np.nan_to_num(table["val"].to_numpy(zero_copy_only=False))
        low = b * block - half - rest
        x = np.zeros(block + 2 * (half + rest))
        x[at - low] = value
        size = 1 << (len(x) + len(kernel) - 2).bit_length()
        made = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(kernel, size), size)
        own = (at >= b * block) & (at < (b + 1) * block)
        keep = pa.array(own)
        return pa.Table.from_arrays([table["trace"].combine_chunks().filter(keep), pa.array(at[own]), pa.array(made[at[own] - low + half])], names=["trace", "z_idx", "filtered"])

    return dealt.groupBy("trace", "block").applyInArrow(one, f"trace {kind}, z_idx long, filtered double")
