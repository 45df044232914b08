"""Delaunay triangles against a version that tries every three points; gridding in them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import triangles


def plain(points):
    """Triangles whose circle holds no point, ties by the rule of in_circle."""
    points, out = sorted(set(points)), set()
    for a, b, c in itertools.combinations(points, 3):
        side = triangles.orient(a, b, c)
        if side and not any(triangles.in_circle(*((a, b, c) if side > 0 else (a, c, b)), p) for p in points if p not in (a, b, c)):
            out.add((*a, *b, *c) if side > 0 else (*a, *c, *b))
    return out


def local(points):
    points, out = sorted(set(points)), set()
    for (i, j), k in triangles.triangulate(points).items():
        if min(i, j, k) >= 0 and i == min(i, j, k):
            out.add((*points[i], *points[j], *points[k]))
    return out


def clouds():
    rng = random.Random(2)
    yield [(rng.random(), rng.random()) for _ in range(40)]
    yield [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(60)]  # many on one circle, many on one line
    yield [(float(k), 0.0) for k in range(9)] + [(3.5, 1.0)]
    yield [(float(k), 2.0 * k) for k in range(9)]
    yield [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]
    yield [(np.cos(k / 3), np.sin(k / 3)) for k in range(19)] + [(0.0, 0.0)]
    yield [(rng.gauss(0, 1) * 1e6, rng.gauss(0, 1) * 1e-3) for _ in range(30)]
    yield [(0.1 * i, 0.1 * j) for i in range(6) for j in range(6)]


@pytest.mark.parametrize("cloud", list(clouds()))
def test_triangulate(cloud):
    cloud = [(float(x), float(y)) for x, y in cloud]
    assert local(cloud) == plain(cloud)


@pytest.mark.parametrize(("tile", "some"), [(4, [0, 1]), (9, [2, 7]), (2048, [3, 4])])
def test_delaunay_in_tiles(spark, tile, some):
    for cloud in [c for k, c in enumerate(clouds()) if k in some]:
        rows = [(float(x), float(y), 1) for x, y in cloud] + [(None, 1.0, 1), (float("nan"), 0.0, 1), (0.5, float("inf"), 1), (float(cloud[0][0]), float(cloud[0][1]), 2)]
        got = triangles.delaunay(spark.createDataFrame(rows, "x double, y double, tile int"), tile)
        assert sorted(map(tuple, got.collect())) == sorted(plain([(float(x), float(y)) for x, y in cloud]))


def test_empty(spark):
    none = spark.createDataFrame([], "x double, y double, val double")
    assert triangles.delaunay(none).count() == 0
    (row,) = triangles.interpolate(none, spark.createDataFrame([(1.0, 2.0)], "x double, y double")).collect()
    assert row.val is None


def test_many_tiles_agree_with_one(spark):
    rng = np.random.default_rng(5)
    cloud = np.concatenate([rng.random((1500, 2)), rng.normal(0.3, 0.002, (1500, 2)), rng.random((60, 2)) * 40]).tolist()
    got = triangles.delaunay(spark.createDataFrame(cloud, "x double, y double"), 250)
    assert {tuple(r) for r in got.collect()} == local([tuple(p) for p in cloud])


def test_interpolate(spark):
    rng = random.Random(4)
    cloud = [(rng.random(), rng.random(), rng.random()) for _ in range(120)] + [(0.5, 0.5, 1.0), (0.5, 0.5, 3.0), (0.2, 0.2, None)]
    targets = [(k, rng.random() * 1.2 - 0.1, rng.random() * 1.2 - 0.1) for k in range(300)] + [(300, 0.5, 0.5), (301, None, 0.1)]
    got = triangles.interpolate(spark.createDataFrame(cloud, "x double, y double, val double"), spark.createDataFrame(targets, "id int, x double, y double"), 25)
    assert got.columns == ["id", "x", "y", "val"]
    values = {}
    for x, y, v in cloud:
        if v is not None:
            values.setdefault((x, y), []).append(v)
    values = {p: sum(v) / len(v) for p, v in values.items()}
    corners = np.array(sorted(plain(list(values)))).reshape(-1, 3, 2)
    for r in got.collect():
        want = None
        for t in corners if r.x is not None else ():
            weights = np.linalg.solve(np.vstack([t.T, np.ones(3)]), [r.x, r.y, 1.0])
            if (weights >= -1e-9).all():
                want = sum(w * values[tuple(p)] for w, p in zip(weights, t.tolist()))
        assert (r.val is None) == (want is None) and (want is None or abs(r.val - want) < 1e-9)


def test_query_over_its_whole_table(spark):
    from terrane.plans import catalog

    sf = "/root/testdata/sf0.001"
    points = {(r.x, r.y) for r in spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y")).collect()}
    t = np.array(sorted(tuple(r[c] for c in triangles._CORNERS) for r in catalog.QUERIES["delaunay_triangles"](spark, sf).collect()))
    assert {tuple(r) for r in t.tolist()} == local(list(points))
    # no point lies in a circle, and as many triangles as points and hull allow: so these are all
    x, y, radius = triangles.circle(t)
    at = np.array(sorted(points))
    assert (np.hypot(at[:, :1] - x, at[:, 1:] - y) > radius * (1 - 1e-9)).all()
    edges = {frozenset((a, b)) for r in t.tolist() for a, b in ((tuple(r[:2]), tuple(r[2:4])), (tuple(r[2:4]), tuple(r[4:])), (tuple(r[4:]), tuple(r[:2])))}
    assert len(points) - len(edges) + len(t) == 1


def test_tiles_are_as_wide_as_high(spark):
    """Points in a long strip: tiles do not become slivers, which know more points beyond their edges than of their own."""
    rng = np.random.default_rng(8)
    for stretch in ((1.0, 300.0), (300.0, 1.0)):
        cloud = spark.createDataFrame((rng.random((4000, 2)) * stretch).tolist(), "x double, y double").cache()
        tiles = triangles.layout(cloud, 100)
        boxes = [tiles.box(k) for k in range(int(tiles.first[-1]))]
        assert 30 <= len(boxes) <= 60
        inner = [(x1 - x0, y1 - y0) for x0, x1, y0, y1 in boxes if np.isfinite([x0, x1, y0, y1]).all()]
        assert not inner or max(max(w / h, h / w) for w, h in inner) < 12
        own, halo = triangles.tiled(cloud, tiles).count(), triangles.tiled(cloud, tiles, halo=True).count()
        assert halo < 2 * own
    got = {tuple(r) for r in triangles.delaunay(cloud, 100).collect()}
    assert got == local([tuple(r) for r in cloud.collect()])


def test_open_points_begin_again_alone(spark, monkeypatch):
    """Rounds after the first triangulate points with open triangles and what bounds their cells, not whole tiles."""
    rng = np.random.default_rng(9)
    cloud = spark.createDataFrame(rng.random((3000, 2)).tolist(), "x double, y double")
    sizes, write = [], triangles.written

    def keep(df):
        out = write(df)
        if df.columns == ["tile", "x", "y", "own"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(triangles, "written", keep)
    got = {tuple(r) for r in triangles.delaunay(cloud, 300).collect()}
    assert got == local([tuple(r) for r in cloud.collect()])
    assert sizes and max(sizes) < 1500
