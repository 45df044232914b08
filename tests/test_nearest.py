"""The nearest of others where many lie within the radius, against all pairs."""

import math

import numpy as np
import pytest

from terrane.operators import points


@pytest.mark.parametrize(("spread", "radius"), [(1.0, 50.0), (300.0, 20.0), (3.0, 1.0)])
def test_nearest_in_tiles(spark, monkeypatch, spread, radius):
    """Tiles and parts that are much smaller than what lies within the radius; clusters, copies, ties and empty places."""
    monkeypatch.setattr(points, "_TILE", 16)
    monkeypatch.setattr(points, "_PART", 40)
    rng = np.random.default_rng(7)
    at = np.round(rng.normal(size=(700, 2)) * [spread, spread / 5], 1)
    to = np.round(np.concatenate([rng.normal(size=(500, 2)) * [spread, spread / 5], at[:40] + [0.5, 0], at[:40] - [0.5, 0], at[40:60], at[40:60]]), 1)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, 1e9, 0.0)]
    b = [(int(k), float(x), float(y)) for k, (x, y) in zip(rng.permutation(len(to)), to)] + [(9000, 1.0, None), (9001, float("inf"), 0.0)]
    got = points.nearest(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "oid long, ox double, oy double"), radius).collect()
    want = {}
    for i, x, y in a[:700]:
        d2, oid = min(((x - u) * (x - u) + (y - v) * (y - v), k) for k, u, v in b[:-2])
        if d2 <= radius * radius:
            want[i] = (oid, math.sqrt(d2))
    assert len(got) == len(want) and {r.id: (r.oid, r.distance) for r in got} == want


def test_nearest_of_few_or_none(spark):
    a = spark.createDataFrame([("p", 1.0, 1.0), ("q", 5.0, 5.0)], "id string, x double, y double")
    b = spark.createDataFrame([("o", 1.0, 2.0)], "oid string, ox double, oy double")
    assert [tuple(r) for r in points.nearest(a, b, 2.0).collect()] == [("p", "o", 1.0)]
    assert points.nearest(a, b.limit(0), 2.0).collect() == [] and points.nearest(a.limit(0), b, 2.0).collect() == []
