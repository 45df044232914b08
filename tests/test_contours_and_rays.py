"""Contour lines, bending rays, empirical modes and fault surfaces against plain versions."""

import math
import random

import numpy as np
import pytest

from terrane.operators import bending, contours


def crossings(value, level):
    """Every crossing of an edge beside a cell whose corners are all defined."""
    sound, above, out = np.isfinite(value), value >= level, {}
    n, m = value.shape
    cell = lambda i, j: 0 <= i < n - 1 and 0 <= j < m - 1 and sound[i : i + 2, j : j + 2].all()
    for i in range(n):
        for j in range(m):
            for k, l, near in ((i, j + 1, ((i, j), (i - 1, j))), (i + 1, j, ((i, j), (i, j - 1)))):
                cells = sum(cell(*c) for c in near)
                if k < n and l < m and cells and above[i, j] != above[k, l]:
                    part = (level - value[i, j]) / (value[k, l] - value[i, j])
                    out[round(i + part * (k - i), 9), round(j + part * (l - j), 9)] = cells
    return out


def field(n, m, seed, holes=0):
    rng = np.random.default_rng(seed)
    i, j = np.mgrid[:n, :m]
    value = np.sin(i / 3.1) + np.cos(j / 2.3) + rng.normal(size=(n, m)) * 0.2
    for _ in range(holes):
        value[rng.integers(n), rng.integers(m)] = np.nan
    return value


@pytest.mark.parametrize(("value", "block"), [(field(25, 31, 1), 6), (field(40, 17, 2, 25), 9), (field(20, 20, 3), 128), (np.hypot(*np.mgrid[-14:15, -14:15]), 4), (np.random.default_rng(5).integers(0, 2, (14, 15)).astype(float), 5)])
def test_contour_lines(spark, value, block):
    level = 10.3 if value.max() > 10 else 0.4
    rows = [(i, j, None if math.isnan(value[i, j]) else float(value[i, j]), 1) for i, j in np.ndindex(value.shape)] + [(None, 1, 2.0, 1)]
    got = contours.contour_lines(spark.createDataFrame(rows, "inl int, crl int, val double, line int"), level, block).collect()
    lines, want = {}, crossings(value, level)
    for r in sorted(got, key=lambda r: (r.line, r.seq)):
        lines.setdefault((r.line, r.closed), []).append((r.seq, r.inl, r.crl))
    met = {}
    for (_, closed), points in lines.items():
        assert [p[0] for p in points] == list(range(len(points)))
        places = [(round(x, 9), round(y, 9)) for _, x, y in points]
        assert closed == (places[0] == places[-1])
        for a, b in zip(places, places[1:]):  # neighbours lie around one cell
            assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1
            met[a], met[b] = met.get(a, 0) + 1, met.get(b, 0) + 1
    assert met == {p: c for p, c in want.items()}  # once for each cell beside it
    if value.max() > 19:  # a cone
        ((_, closed),) = lines
        (points,) = lines.values()
        x, y = np.array([p[1] for p in points]), np.array([p[2] for p in points])
        assert closed and abs(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2 - math.pi * 10.3**2) < 3


def test_no_contours(spark):
    kind = "inl int, crl int, val double"
    assert contours.contour_lines(spark.createDataFrame([], kind), 1.0).count() == 0
    assert contours.contour_lines(spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, None)], kind), 1.0).count() == 0


def test_bending_rays(spark):
    rng = random.Random(1)
    rows = [(m, k, rng.uniform(1, 300), rng.uniform(300, 6000), 0) for m in range(40) for k in range(rng.randint(1, 7))]
    rows += [(90, 0, 100.0, 2000.0, 0), (90, 1, 100.0, 2000.0, 0), (91, 0, None, 1.0, 0), (91, 1, 0.0, 5.0, 0), (91, 2, 5.0, None, 0)]
    got = bending.bending_rays(spark.createDataFrame(rows, "model int, layer int, thickness double, vp double, p int"), [0.0, 10.0, 900.0, 1e5]).collect()
    assert len(got) == 4 * (len(rows) - 3)
    for r in got:
        own = [(h, v) for m, k, h, v, _ in rows if m == r.model and k <= r.layer]
        angles = [math.asin(min(1.0, r.p * v)) for _, v in own]
        if max(r.p * v for _, v in own) < 1 - 1e-9:  # beyond, sines no longer tell offsets apart
            assert math.isclose(sum(2 * h * math.tan(a) for (h, _), a in zip(own, angles)), r.offset, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(math.sin(r.angle) / own[-1][1], r.p, rel_tol=1e-9, abs_tol=1e-15)
        if len({v for _, v in own}) == 1:
            assert math.isclose(r.twt, math.hypot(2 * sum(h for h, _ in own), r.offset) / own[0][1], rel_tol=1e-6)
        if r.offset == 0:
            assert r.p == 0 and math.isclose(r.twt, sum(2 * h / v for h, v in own), rel_tol=1e-12)


def plain_spline(x, y, at):
    """Natural spline by a dense system of second derivatives."""
    n, h = len(x), np.diff(x)
    system, right = np.eye(n), np.zeros(n)
    for k in range(1, n - 1):
        system[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        right[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    m = np.linalg.solve(system, right)
    out = []
    for t in at:
        k = min(max(0, sum(v <= t for v in x) - 1), n - 2)
        a, b = (x[k + 1] - t) / h[k], (t - x[k]) / h[k]
        out.append(a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6)
    return np.array(out)


def plain_modes(x, components, stop, rounds):
    def peaks(y, sign):
        out, k = [], 1
        while k < len(y) - 1:
            end = k
            while end + 1 < len(y) and y[end + 1] == y[k]:
                end += 1
            if end + 1 < len(y) and sign * y[k] > sign * y[k - 1] and sign * y[k] > sign * y[end + 1]:
                out.append(k)
            k = end + 1
        return out

    out, rest = [], list(x)
    while len(out) < components and min(len(peaks(rest, 1)), len(peaks(rest, -1))) >= 2:
        mode = np.array(rest)
        for _ in range(rounds):
            both = [peaks(mode, 1), peaks(mode, -1)]
            if min(map(len, both)) < 2:
                break
            around = []
            for at in both:
                known = [0, *at, len(x) - 1]
                around.append(plain_spline(np.array(known, float), np.array([mode[at[0]], *mode[at], mode[at[-1]]]), np.arange(len(x))))
            mean = (around[0] + around[1]) / 2
            moved = (mean**2).sum() / (mode**2).sum()
            mode = mode - mean
            if moved < stop:
                break
        out.append(mode)
        rest = list(np.array(rest) - mode)
    return [*out, np.array(rest)]


def test_empirical_modes(spark):
    rng = np.random.default_rng(3)
    t = np.arange(150)
    rows = [(0, (np.sin(t / 2) + 2 * np.sin(t / 15) + t / 50).tolist()), (1, rng.normal(size=80).tolist()), (2, rng.integers(0, 3, 60).astype(float).tolist()), (3, [1.0, 2.0]), (4, []), (5, None), (6, [None, 1.0, None])]
    got = {}
    for r in bending.empirical_modes(spark.createDataFrame(rows, "trace int, samples array<double>"), 4, 0.01, 20).orderBy("trace", "mode").collect():
        got.setdefault(r.trace, []).append(np.array(r.samples))
    assert set(got) == {0, 1, 2, 3, 4, 6} and len(got[0]) >= 3
    for k, x in rows:
        if x is not None:
            x = np.array([v or 0.0 for v in x])
            assert np.allclose(sum(got[k]), x, atol=1e-9)
            want = plain_modes(x, 4, 0.01, 20) if len(x) else [x]
            assert len(want) == len(got[k]) and all(np.allclose(a, b, atol=1e-6) for a, b in zip(want, got[k])), k
    assert np.corrcoef(got[0][0][20:-20], np.sin(t / 2)[20:-20])[0, 1] > 0.98


def test_fault_surfaces(spark):
    rng = random.Random(2)
    plane = lambda s, k: (100.0 * s + 3.0 * k, 20.0 * s - 2.0 * k, 50.0 * k)
    numbers = list(range(9))
    rng.shuffle(numbers)
    rows = [("f", numbers[s], k if s % 3 else 6 - k, *plane(s, k)) for s in range(9) for k in range(7 if s != 4 else 4)]
    rows += [("one", 1, k, *plane(0, k)) for k in range(5)] + [("dots", k, 0, *plane(k, 0)) for k in range(3)] + [("f", 77, 1, None, 1.0, 1.0)]
    rng.shuffle(rows)
    got = bending.fault_surfaces(spark.createDataFrame(rows, "fault string, stick int, seq int, x double, y double, z double")).collect()
    assert {r.fault for r in got} == {"f"}
    # between sticks of n and m points lie n + m - 2 triangles
    sizes = [7 if s != 4 else 4 for s in range(9)]
    assert len(got) == sum(a + b - 2 for a, b in zip(sizes, sizes[1:])) and sorted(r.triangle for r in got) == list(range(len(got)))
    of = {plane(s, k): (s, k) for s in range(9) for k in range(7)}
    corners = [[of[tuple(r[f"{c}{k}"] for c in "xyz")] for k in (1, 2, 3)] for r in got]
    assert all(len({s for s, _ in t}) == 2 and max(s for s, _ in t) - min(s for s, _ in t) == 1 for t in corners)
    area = lambda r: np.linalg.norm(np.cross([r.x2 - r.x1, r.y2 - r.y1, r.z2 - r.z1], [r.x3 - r.x1, r.y3 - r.y1, r.z3 - r.z1])) / 2
    whole = np.linalg.norm(np.cross([100.0, 20.0, 0.0], [3.0, -2.0, 50.0]))
    full = [r for r, t in zip(got, corners) if 4 not in {s for s, _ in t}]
    assert abs(sum(map(area, full)) - 6 * 6 * whole) < 1e-6 * whole


def test_ray_parameters_take_few_trials(monkeypatch):
    """The root by bisection of all, and that it takes a few trials, not one for each bit."""
    rng = np.random.default_rng(5)
    h, v = rng.integers(0, 51, (400, 7)) * 1.0, 1500 + 30.0 * rng.integers(1, 51, (400, 7))
    h[:, 0] += 1
    offset = rng.choice([0.0, 50.0, 400.0, 5000.0], 400)
    trials, whole = [], np.sqrt
    monkeypatch.setattr(bending.np, "sqrt", lambda x: trials.append(np.size(x)) or whole(x))
    p = bending.ray_parameters(h, v, offset)
    monkeypatch.undo()
    assert sum(trials) <= 15 * h.size
    fast = np.where(h > 0, v, 0).max(1)
    low, high = np.zeros(400), 1 / fast
    for _ in range(100):
        m = (low + high) / 2
        s = m[:, None] * v
        less = (2 * h * s / np.sqrt(np.maximum((1 - s) * (1 + s), 1e-300))).sum(1) < offset
        low, high = np.where(less, m, low), np.where(less, high, m)
    assert np.allclose(p, (low + high) / 2, rtol=1e-12, atol=1e-20)


def test_bending_rays_across_batches(spark, monkeypatch):
    """Models that batches and steps cut, and models that are null, give the rays that they give alone."""
    rng = np.random.default_rng(6)
    rows = [(m if m else None, k, float(rng.integers(0, 9)), float(rng.integers(0, 4)) * 700 + 800) for m in range(30) for k in range(int(rng.integers(1, 40)))]
    monkeypatch.setattr(bending, "_RAYS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = bending.bending_rays(spark.createDataFrame(rows, "model int, layer int, thickness double, vp double"), [0.0, 30.0]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for m in {r[0] for r in rows}:
        own = [r for r in sorted((r for r in rows if r[0] == m), key=lambda r: r[1]) if r[2] > 0]
        for k, r in enumerate(own):
            h, v = (np.array([[x[c] for x in own[: k + 1]]]) for c in (2, 3))
            for x in (0.0, 30.0):
                want[m, r[1], x] = bending.ray_parameters(h, v, np.array([x]))[0]
    assert len(got) == len(want) and all(abs(g.p - want[g.model, g.layer, g.offset]) <= 1e-13 * g.p for g in got)
