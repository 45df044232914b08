"""Attributes of volumes that look at traces around: dips, coherency, dip filters and smoothing along dips.

A volume has a row for each trace: inl, crl, samples (array of doubles, null for undefined). Traces are dealt to bricks,
those near a brick's edge to its neighbours too; a task works on one brick and its edge as one array.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Traces along the side of a brick.
BRICK = 16


def attribute(volume: DataFrame, stepout: int, names: list[str], f: Callable[[np.ndarray], list[np.ndarray]], brick: int = BRICK) -> DataFrame:
    """inl, crl and, for each name, an array as long as the trace: what f gives for the traces of a brick.

    f gets (inl, crl, sample) with `stepout` traces around and NaN where a trace or sample is missing, and returns arrays
    without what is around. NaN comes back as null. Rows with a null position or without samples are left out; of
    repeated traces the one of least samples counts; an empty volume gives no rows; other columns are ignored.
    """
    rows = volume.select(F.col("inl").cast("long").alias("inl"), F.col("crl").cast("long").alias("crl"), F.transform("samples", lambda x: x.cast("double")).alias("samples")).where("inl IS NOT NULL AND crl IS NOT NULL AND samples IS NOT NULL")
    rows = rows.groupBy("inl", "crl").agg(F.min("samples").alias("samples"))

    def near(c: str) -> Column:  # the one or two bricks that need a trace
        return F.array_distinct(F.array(*(F.floor((F.col(c) + d) / brick) for d in (-stepout, 0, stepout))))

    dealt = rows.select("*", F.explode(near("inl")).alias("bi")).select("*", F.explode(near("crl")).alias("bj"))
    schema = pa.schema([("inl", pa.int64()), ("crl", pa.int64()), *((n, pa.list_(pa.float64())) for n in names)])

    def one(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py() * brick, table["bj"][0].as_py() * brick
        inl, crl = table["inl"].to_numpy(), table["crl"].to_numpy()
        samples = [s.values.to_numpy(zero_copy_only=False) for s in table["samples"]]
        deep = max(map(len, samples))
        cube = np.full((brick + 2 * stepout, brick + 2 * stepout, deep), np.nan)
        for i, j, s in zip(inl - bi + stepout, crl - bj + stepout, samples):
            cube[i, j, : len(s)] = s
        own = np.flatnonzero((inl // brick * brick == bi) & (crl // brick * brick == bj))
        with np.errstate(all="ignore"):
            made = f(cube)
        columns = []
        for m in made:
            picked = [m[inl[k] - bi, crl[k] - bj, : len(samples[k])] for k in own]
            flat = pa.array(np.concatenate(picked) if picked else np.zeros(0), from_pandas=True)
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, picked)]), pa.int32()), flat))
        return pa.Table.from_arrays([pa.array(inl[own]), pa.array(crl[own]), *columns], schema=schema)

    return dealt.groupBy("bi", "bj").applyInArrow(one, f"inl long, crl long, {', '.join(f'{n} array<double>' for n in names)}")


def shifted(traces: np.ndarray, shift) -> np.ndarray:
    """Samples at z + shift, linear between samples; NaN beyond the ends or beside undefined samples. shift: a number, or an
    array as large as traces."""
    deep = traces.shape[-1]
    at = np.arange(deep) + shift
    at = np.where(np.isfinite(at), at, -9.0)
    low = np.floor(at).astype(np.int64)
    part = at - low
    last = (low == deep - 1) & (part == 0)
    low, part = np.where(last, low - 1, low), np.where(last, 1.0, part)
    inside = (low >= 0) & (low < deep - 1)
    low = np.broadcast_to(np.clip(low, 0, max(deep - 2, 0)), traces.shape)
    one, two = np.take_along_axis(traces, low, -1), np.take_along_axis(traces, np.minimum(low + 1, deep - 1), -1)
    value = np.where(part == 0, one, np.where(part == 1, two, one * (1 - part) + two * part))
    return np.where(inside, value, np.nan)


def around(cube: np.ndarray, stepout: int, inl_dip=0.0, crl_dip=0.0) -> np.ndarray:
    """The traces around each one, along its dips: (offset, inl, crl, sample), by inline and then crossline offset."""
    n, m = cube.shape[0] - 2 * stepout, cube.shape[1] - 2 * stepout
    offsets = [(i, j) for i in range(-stepout, stepout + 1) for j in range(-stepout, stepout + 1)]
    return np.stack([shifted(cube[stepout + i : stepout + i + n, stepout + j : stepout + j + m], i * inl_dip + j * crl_dip) for i, j in offsets])


def gated(x: np.ndarray, half: int) -> np.ndarray:
    """Sums over 2 * half + 1 samples around each; NaN where one is missing."""
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half)], constant_values=np.nan)
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, -1).sum(-1)


def _scan(cube: np.ndarray, stepout: int, half: int, dips: np.ndarray) -> list[np.ndarray]:
    n, m, deep = cube.shape[0] - 2 * stepout, cube.shape[1] - 2 * stepout, cube.shape[2]
    best, inl, crl = np.full((n, m, deep), -1.0), np.full((n, m, deep), np.nan), np.full((n, m, deep), np.nan)
    for p in dips.tolist():
        for q in dips.tolist():
            near = around(cube, stepout, p, q)
            energy = gated((near * near).sum(0), half)
            like = np.where(energy > 0, gated(near.sum(0) ** 2, half) / (len(near) * energy), np.where(energy == 0, 0.0, np.nan))
            like = np.round(like, 12)
            better = like > best
            best[better], inl[better], crl[better] = like[better], p, q
    best[best < 0] = np.nan
    return [best, inl, crl]


def dip_scan(volume: DataFrame, most: float, step: float, stepout: int = 1, half: int = 4, brick: int = BRICK) -> DataFrame:
    """coherency, inl_dip, crl_dip (samples a trace): the dips, of those from -most to most by `step`, along which the traces
    around are most alike, and their semblance. Ties go to the lesser inline, then crossline dip; samples whose
    surroundings are incomplete for every dip have none, those without energy coherency 0."""
    dips = step * np.arange(-math.floor(most / step + 1e-9), math.floor(most / step + 1e-9) + 1)
    return attribute(volume, stepout, ["coherency", "inl_dip", "crl_dip"], lambda cube: _scan(cube, stepout, half, dips), brick)


def _tensor(cube: np.ndarray, stepout: int, half: int) -> list[np.ndarray]:
    inner = cube[1:-1, 1:-1]
    gi, gj = (cube[2:, 1:-1] - cube[:-2, 1:-1]) / 2, (cube[1:-1, 2:] - cube[1:-1, :-2]) / 2
    gz = np.full_like(inner, np.nan)
    gz[..., 1:-1] = (inner[..., 2:] - inner[..., :-2]) / 2
    gradient = np.stack([gi, gj, gz])
    wide = gradient[:, None] * gradient[None]
    n, m = cube.shape[0] - 2 * stepout, cube.shape[1] - 2 * stepout
    reach = 2 * (stepout - 1) + 1
    total = gated(sum(wide[:, :, i : i + n, j : j + m] for i in range(reach) for j in range(reach)), half)
    sound = np.isfinite(total).all((0, 1))
    matrices = np.moveaxis(np.where(sound, total, 0.0), (0, 1), (-2, -1))
    values, vectors = np.linalg.eigh(matrices)
    normal = vectors[..., -1]
    steep = ~sound | (np.abs(normal[..., 2]) < 1e-6)
    flat = values.sum(-1)
    planarity = np.where(sound & (flat > 0), (values[..., 2] - values[..., 1]) / np.where(flat > 0, flat, 1.0), np.nan)
    return [np.where(steep, np.nan, -normal[..., 0] / normal[..., 2]), np.where(steep, np.nan, -normal[..., 1] / normal[..., 2]), planarity]


def gradient_dip(volume: DataFrame, stepout: int = 2, half: int = 4, brick: int = BRICK) -> DataFrame:
    """inl_dip, crl_dip (samples a trace) and planarity (0 to 1) by the main direction of gradients: central differences,
    their products summed over stepout - 1 traces and half samples each way. Null where a difference is missing, and dips
    also where the direction lies flat."""
    if stepout < 1:
        raise ValueError("differences reach one trace at least")
    return attribute(volume, stepout, ["inl_dip", "crl_dip", "planarity"], lambda cube: _tensor(cube, stepout, half), brick)


def _eigen(cube: np.ndarray, stepout: int, half: int, tensor: int) -> list[np.ndarray]:
    trim = lambda c, k: c[k : c.shape[0] - k or None, k : c.shape[1] - k or None]
    p, q, _ = _tensor(cube, tensor, half) if tensor else (0.0, 0.0, None)
    near = around(trim(cube, max(tensor - stepout, 0)), stepout, trim(p, max(stepout - tensor, 0)) if tensor else 0.0, trim(q, max(stepout - tensor, 0)) if tensor else 0.0)
    pairs = gated(near[:, None] * near[None], half)
    sound = np.isfinite(pairs).all((0, 1))
    matrices = np.moveaxis(np.where(sound, pairs, 0.0), (0, 1), (-2, -1))
    energy = np.trace(matrices, axis1=-2, axis2=-1)
    return [np.where(sound & (energy > 0), np.linalg.eigvalsh(matrices)[..., -1] / np.where(energy > 0, energy, 1.0), np.nan)]


def eigen_coherency(volume: DataFrame, stepout: int = 1, half: int = 4, steer: int = 2, brick: int = BRICK) -> DataFrame:
    """coherency: the greatest eigenvalue over the sum of all, of the products of the traces around with each other, over
    half samples each way; along the gradients' dips (see gradient_dip, stepout `steer`), or flat with steer 0."""
    return attribute(volume, max(stepout, steer), ["coherency"], lambda cube: _eigen(cube, stepout, half, steer), brick)


def fan(size: int, low: float | None, high: float | None, taper: float) -> np.ndarray:
    """Weights (inl, crl, sample) of a dip filter: 1 where the slope |samples| / distance lies between low and high (either
    may be missing), falling as a cosine over the share `taper` of the bound, or of the width between both, inside it;
    they sum to 1."""
    half = size // 2
    i, j, k = np.mgrid[-half : half + 1, -half : half + 1, -half : half + 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.abs(k) / np.hypot(i, j)
    width = (high - low if low is not None and high is not None else high if high is not None else low) * taper
    ramp = lambda inside: 0.5 - 0.5 * np.cos(np.pi * np.clip(inside / width, 0, 1)) if width > 0 else (inside >= 0).astype(float)
    weight = np.ones(slope.shape)
    if low is not None:
        weight = weight * ramp(slope - low)
    if high is not None:
        weight = weight * ramp(high - slope)
    weight[half, half, half] = 1.0
    return weight / weight.sum()


def dip_filter(volume: DataFrame, size: int = 5, low: float | None = None, high: float | None = 1.0, taper: float = 0.2, brick: int = BRICK) -> DataFrame:
    """filtered: each sample's surroundings weighted by fan(...); what is missing counts as 0, what is missing itself stays so."""
    if low is None and high is None:
        raise ValueError("a dip filter has a bound")
    half, weights = size // 2, fan(size, low, high, taper)

    def f(cube: np.ndarray) -> list[np.ndarray]:
        n, m, deep = cube.shape[0] - 2 * half, cube.shape[1] - 2 * half, cube.shape[2]
        wide = np.pad(np.nan_to_num(cube), ((0, 0), (0, 0), (half, half)))
        out = sum(weights[i, j, k] * wide[i : i + n, j : j + m, k : k + deep] for i in range(size) for j in range(size) for k in range(size) if weights[i, j, k])
        return [np.where(np.isnan(cube[half : half + n, half : half + m]), np.nan, out)]

    return attribute(volume, half, ["filtered"], f, brick)


def steered_smoother(volume: DataFrame, stepout: int = 1, steer: int = 2, half: int = 4, median: bool = True, brick: int = BRICK) -> DataFrame:
    """smoothed: the median (or mean) of the traces around along the gradients' dips, of those that are there; null where no
    dip is known."""

    def f(cube: np.ndarray) -> list[np.ndarray]:
        trim = lambda c, k: c[k : c.shape[0] - k or None, k : c.shape[1] - k or None]
        p, q, _ = _tensor(cube, steer, half)
        k = max(stepout - steer, 0)
        near = around(trim(cube, max(steer - stepout, 0)), stepout, trim(p, k), trim(q, k))
        near[:, np.isnan(trim(p, k))] = np.nan
        some = np.isfinite(near).any(0)
        near = np.where(some, near, 0.0)
        return [np.where(some, np.nanmedian(near, 0) if median else np.nanmean(near, 0), np.nan)]

    return attribute(volume, max(stepout, steer), ["smoothed"], f, brick)
