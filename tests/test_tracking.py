"""Horizon tracking against a plain best-first tracker of the whole volume."""

import heapq
import random

import numpy as np
import pytest

from terrane.operators import tracking


def plain(volume, seeds, half, reach, least):
    """One queue for the whole volume."""
    heap, out = [(-1.0, (-(1 << 62), z), (i, j), z) for i, j, z in seeds if (i, j) in volume and half <= z < len(volume[i, j]) - half], {}
    heapq.heapify(heap)
    while heap:
        score, _, node, z = heapq.heappop(heap)
        if node in out:
            continue
        out[node] = (z, -score)
        for di, dj in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            other = (node[0] + di, node[1] + dj)
            if other in volume and other not in out:
                found = tracking.best_shift(volume[node], volume[other], z, half, reach)
                if found and found[0] >= least:
                    heapq.heappush(heap, (-found[0], node, other, found[1]))
    return out


def planted(rows, columns, fault=None):
    """Two events; behind the fault's column everything lies 20 samples deeper."""
    wave = lambda t: (1 - 0.5 * t * t) * np.exp(-0.25 * t * t)
    out, z = {}, {}
    for i in range(rows):
        for j in range(columns):
            at = round(30 + 6 * np.sin(i / 7) + 4 * np.cos(j / 5)) + (20 if fault is not None and j >= fault else 0)
            t = np.arange(120)
            out[i, j], z[i, j] = wave(t - at) + 0.6 * wave((t - at - 25) / 1.5), at
    return out, z


def frame(spark, volume):
    return spark.createDataFrame([(i, j, [float(x) for x in s], 0) for (i, j), s in volume.items()], "inl int, crl int, samples array<double>, z int")


@pytest.mark.parametrize("brick", [5, 64])
def test_planted_horizon(spark, brick):
    volume, z = planted(14, 17, fault=12)
    del volume[3, 4], volume[3, 5]
    seeds = [(2, 2, z[2, 2]), (99, 0, 5), (5, 5, 0)]
    got = tracking.track(frame(spark, volume), spark.createDataFrame([*seeds, (None, 1, 2)], "inl int, crl int, z int"), 6, 3, 0.9, brick)
    got = {(r.inl, r.crl): (r.z, r.score) for r in got.collect()}
    assert got == plain(volume, seeds, 6, 3, 0.9)
    assert {n: v[0] for n, v in got.items()} == {n: z[n] for n in volume if n[1] < 12}


def test_one_brick_of_noise(spark):
    rng = random.Random(3)
    volume = {(i, j): np.array([rng.gauss(0, 1) for _ in range(40)]) for i in range(9) for j in range(9)}
    seeds = [(4, 4, 20), (1, 1, 10)]
    got = tracking.track(frame(spark, volume), spark.createDataFrame(seeds, "inl int, crl int, z int"), 3, 4, 0.5)
    assert {(r.inl, r.crl): (r.z, r.score) for r in got.collect()} == plain(volume, seeds, 3, 4, 0.5)


def test_odd_tables(spark):
    kind = "inl int, crl int, samples array<double>"
    none = spark.createDataFrame([], kind)
    seeds = spark.createDataFrame([(1, 1, 5)], "inl int, crl int, z int")
    assert tracking.track(none, seeds).count() == 0
    some = spark.createDataFrame([(1, 1, [None] * 20), (1, 2, [1.0] * 20), (None, 1, [1.0]), (2, 1, None), (1, 1, [None] * 20)], kind)
    assert [(r.inl, r.crl, r.z, r.score) for r in tracking.track(some, seeds).collect()] == [(1, 1, 5, 1.0)]
    assert tracking.track(some, seeds.where("false")).count() == 0
