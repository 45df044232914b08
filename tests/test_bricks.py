"""Volume attributes against loops over single samples, and on planted planes."""

import math

import numpy as np
import pytest

from terrane.operators import bricks


def frame(spark, cube, gone=()):
    rows = [(i, j, [None if math.isnan(x) else float(x) for x in cube[i, j]], 1) for i in range(cube.shape[0]) for j in range(cube.shape[1]) if (i, j) not in gone]
    return spark.createDataFrame(rows, "inl int, crl int, samples array<double>, bi int").repartition(3)


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.inl, r.crl] = [np.nan if x is None else x for x in r[name]]
    return out


def planes(shape, a, b):
    i, j, k = np.mgrid[: shape[0], : shape[1], : shape[2]]
    t = k - a * i - b * j
    return np.sin(t / 5) + 0.5 * np.sin(t / 8 + 1)


@pytest.mark.parametrize(("a", "b"), [(0.5, -1.0), (0.0, 0.0), (-1.5, 0.5)])
def test_planted_planes(spark, a, b):
    cube = planes((7, 8, 60), a, b)
    scan = bricks.dip_scan(frame(spark, cube), 2.0, 0.5, brick=4)
    inside = (slice(1, -1), slice(1, -1), slice(15, -15))
    assert np.allclose(back(scan, "inl_dip", cube.shape)[inside], a) and np.allclose(back(scan, "crl_dip", cube.shape)[inside], b)
    assert back(scan, "coherency", cube.shape)[inside].min() > 0.995
    tensor = bricks.gradient_dip(frame(spark, cube), brick=3)
    inside = (slice(2, -2), slice(2, -2), slice(15, -15))
    assert np.abs(back(tensor, "inl_dip", cube.shape)[inside] - a).max() < 0.05 and np.abs(back(tensor, "crl_dip", cube.shape)[inside] - b).max() < 0.05
    along = back(bricks.eigen_coherency(frame(spark, cube), brick=5), "coherency", cube.shape)
    flat = back(bricks.eigen_coherency(frame(spark, cube), steer=0, brick=5), "coherency", cube.shape)
    assert along[inside].min() > 0.99 and (a == b == 0 or flat[inside].mean() < along[inside].mean())
    smooth = back(bricks.steered_smoother(frame(spark, cube), brick=4), "smoothed", cube.shape)
    assert np.abs(smooth - cube)[inside].max() < 0.12


def noisy():
    rng = np.random.default_rng(4)
    cube = rng.normal(size=(6, 5, 24))
    cube[2, 3, 10] = np.nan
    return cube, {(4, 1)}


def at(cube, gone, i, j, z):
    if (i, j) in gone or not (0 <= i < cube.shape[0] and 0 <= j < cube.shape[1]):
        return math.nan
    low = math.floor(z)
    if not 0 <= z <= cube.shape[2] - 1:
        return math.nan
    low = min(low, cube.shape[2] - 2)
    part = z - low
    return cube[i, j, low] if part == 0 else cube[i, j, low + 1] if part == 1 else cube[i, j, low] * (1 - part) + cube[i, j, low + 1] * part


def test_scan_and_eigen_by_loops(spark):
    cube, gone = noisy()
    scan = bricks.dip_scan(frame(spark, cube, gone), 0.5, 0.5, 1, 2, brick=4)
    eigen = back(bricks.eigen_coherency(frame(spark, cube, gone), 1, 2, 0, brick=4), "coherency", cube.shape)
    got = [back(scan, n, cube.shape) for n in ("coherency", "inl_dip", "crl_dip")]
    for i, j, z in np.ndindex(cube.shape):
        if (i, j) in gone:
            continue
        best = (-1.0, math.nan, math.nan)
        for p in (-0.5, 0.0, 0.5):
            for q in (-0.5, 0.0, 0.5):
                near = np.array([[at(cube, gone, i + a, j + b, z + k + a * p + b * q) if 0 <= z + k < cube.shape[2] else math.nan for k in range(-2, 3)] for a in (-1, 0, 1) for b in (-1, 0, 1)])
                like = round(float((near.sum(0) ** 2).sum() / (9 * (near**2).sum())), 12)
                if like > best[0]:
                    best = (like, p, q)
                if p == q == 0:
                    values = np.linalg.eigvalsh(near @ near.T) if np.isfinite(near).all() else None
                    assert (values is None) == math.isnan(eigen[i, j, z]) and (values is None or abs(values[-1] / values.sum() - eigen[i, j, z]) < 1e-9)
        want = (math.nan,) * 3 if best[0] < 0 else best
        assert all((math.isnan(w) and math.isnan(g[i, j, z])) or abs(w - g[i, j, z]) < 1e-9 for w, g in zip(want, got)), (i, j, z)


@pytest.mark.parametrize(("size", "low", "high"), [(3, None, 1.0), (5, 0.4, None), (5, 0.2, 1.5)])
def test_dip_filter_by_loops(spark, size, low, high):
    cube, gone = noisy()
    got = back(bricks.dip_filter(frame(spark, cube, gone), size, low, high, 0.3, brick=4), "filtered", cube.shape)
    half, weights = size // 2, {}
    for i, j, k in np.ndindex((size,) * 3):
        d, t = math.hypot(i - half, j - half), abs(k - half)
        slope, w = t / d if d else math.inf, 1.0
        width = 0.3 * (high - low if low is not None and high is not None else high or low)
        for inside in ([] if low is None else [slope - low]) + ([] if high is None else [high - slope]):
            w *= 1.0 if inside >= width else 0.0 if inside <= 0 else 0.5 - 0.5 * math.cos(math.pi * inside / width)
        weights[i - half, j - half, k - half] = 1.0 if (d, t) == (0, 0) else w
    total = sum(weights.values())
    for i, j, z in np.ndindex(cube.shape):
        if (i, j) in gone or math.isnan(cube[i, j, z]):
            assert math.isnan(got[i, j, z])
            continue
        terms = [(w, at(cube, gone, i + a, j + b, z + k)) for (a, b, k), w in weights.items()]
        assert abs(sum(w * x for w, x in terms if not math.isnan(x)) / total - got[i, j, z]) < 1e-9


def test_odd_volumes(spark):
    kind = "inl int, crl int, samples array<double>"
    assert bricks.gradient_dip(spark.createDataFrame([], kind)).count() == 0
    odd = spark.createDataFrame([(1, 1, [1.0, None]), (1, 1, [1.0, None]), (None, 2, [1.0]), (2, 2, None), (-3, -20, [])], kind)
    assert sorted((r.inl, r.crl, r.filtered) for r in bricks.dip_filter(odd).collect()) == [(-3, -20, []), (1, 1, [1.0 * bricks.fan(5, None, 1.0, 0.2)[2, 2, 2], None])]
    assert [r.smoothed for r in bricks.steered_smoother(odd.where("inl = 1")).collect()] == [[None, None]]
