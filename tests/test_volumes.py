import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import signals, volumes


def test_voxel_components_against_flood_fill(spark):
    rng = np.random.default_rng(5)
    cube = rng.random((7, 6, 5))
    rows = [(i, c, z, float(cube[i, c, z])) for i, c, z in itertools.product(range(7), range(6), range(5))] + [(9, 9, 9, None)]
    got = volumes.voxel_components(spark.createDataFrame(rows, "inl long, crl long, z long, val double"), 0.0, 0.4, 2)
    left, want = {x[:3] for x in rows if x[3] is not None and x[3] <= 0.4}, set()
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            at = todo.pop()
            part.add(at)
            for k, s in itertools.product(range(3), (-1, 1)):
                near = tuple(x + s * (j == k) for j, x in enumerate(at))
                if near in left:
                    left.remove(near)
                    todo.append(near)
        if len(part) > 1:
            want |= {(*x, min((i << 40) + (c << 20) + z for i, c, z in part), len(part)) for x in part}
    assert {tuple(x) for x in got.collect()} == want


def test_principal_components_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(200, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5)]
    got = volumes.principal_components(spark.createDataFrame(rows, "id long, e array<double>").repartition(7), "e").orderBy("component").collect()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose([g["eigenvalue"] for g in got], values)
    assert np.allclose(sum(g["share"] for g in got), 1)


def test_empty_tables(spark):
    vectors = spark.createDataFrame([], "id long, e array<double>")
    assert volumes.principal_components(vectors, "e").count() == 0
    empty = spark.createDataFrame([], "trace long, z_idx int, val double")
    assert signals.gap_decon(empty, 1, 2, 0.01).count() == 0
    assert volumes.voxel_components(spark.createDataFrame([], "inl long, crl long, z long, val double"), 0.0, 1.0, 1).count() == 0


@pytest.mark.parametrize("length", [1, 3])
def test_gap_decon_removes_what_can_be_predicted(spark, length):
    wave = np.zeros(400)
    wave[0] = 1
    for k in range(1, 400):
        wave[k] = 0.8 * wave[k - 1]
    rows = [(1, k, float(x)) for k, x in enumerate(wave)] + [(2, k, 0.0) for k in range(3)]
    got = signals.gap_decon(spark.createDataFrame(rows, "trace long, z_idx int, val double"), 1, length, 0.0)
    out = {(g["trace"], g["z_idx"]): g["decon"] for g in got.collect()}
    assert abs(out[1, 0] - 1) < 1e-9 and max(abs(out[1, k]) for k in range(1, 300)) < 1e-6
    assert out[2, 1] == 0


def test_band_kernel_passes_its_band(spark):
    rows = [(t, k, float(np.cos(2 * np.pi * f * k))) for t, f in enumerate((0.01, 0.12, 0.35)) for k in range(200)]
    df = spark.createDataFrame(rows, "trace long, z_idx int, val double")
    got = df.withColumn("y", signals.kernel_sum(signals.band_kernel(0.05, 0.2, 40))).where("z_idx BETWEEN 60 AND 140")
    power = {g["trace"]: g["p"] for g in got.groupBy("trace").agg(F.avg(F.col("y") ** 2).alias("p")).collect()}
    assert power[0] < 1e-3 and abs(power[1] - 0.5) < 0.02 and power[2] < 1e-3
