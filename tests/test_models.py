"""Rays, reflections, samplings, contours, statics and columns of text: edge cases by hand."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import models
from terrane.sources import text


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_zoeppritz_limits(spark):
    c = [F.lit(x) for x in (2000.0, 1000.0, 2.0, 2600.0, 1400.0, 2.2)]
    same = [F.lit(x) for x in (2000.0, 1000.0, 2.0)] * 2
    got = spark.range(1).select(
        models.zoeppritz(*c, F.lit(0.0)), models.zoeppritz(*same, F.lit(0.4)), models.zoeppritz(*c, F.lit(math.asin(2000 / 2600) + 1e-6)), models.zoeppritz(*c[:5], F.lit(None).cast("double"), F.lit(0.1))
    ).first()
    acoustic = (2600 * 2.2 - 2000 * 2.0) / (2600 * 2.2 + 2000 * 2.0)
    assert got[0] == pytest.approx(acoustic, abs=1e-12) and got[1] == pytest.approx(0, abs=1e-12) and got[2] is None and got[3] is None


def test_zoeppritz_small_angles(spark):
    """Close to the normal, the three-term approximation of small contrasts holds."""
    vp, vs, rho, dvp, dvs, drho, angle = 3000.0, 1500.0, 2.3, 30.0, 10.0, 0.02, 0.2
    half = [vp - dvp / 2, vs - dvs / 2, rho - drho / 2, vp + dvp / 2, vs + dvs / 2, rho + drho / 2]
    got = spark.range(1).select(models.zoeppritz(*map(F.lit, half), F.lit(angle))).first()[0]
    k, s2 = (vs / vp) ** 2, math.sin(angle) ** 2
    want = 0.5 * (1 - 4 * k * s2) * drho / rho + dvp / vp / 2 / math.cos(angle) ** 2 - 4 * k * s2 * dvs / vs
    assert got == pytest.approx(want, abs=2e-4)


def test_rays_of_one_layer_are_straight(spark):
    layers = spark.createDataFrame([(1, 1, 300.0, 2000.0)], "model int, layer int, thickness double, vp double")
    (got,) = models.rays(layers, [800.0]).select("t0", "vrms", "twt", "angle").collect()
    assert tuple(got) == pytest.approx((0.3, 2000.0, 2 * math.hypot(300, 400) / 2000, math.atan2(400, 300)))


def test_regular_holes_nulls_and_repeats(spark):
    log = spark.createDataFrame([("w", 0.0, 1.0), ("w", 2.0, 3.0), ("w", 2.0, 9.0), ("w", 7.0, 8.0), ("w", None, 5.0), ("w", 3.0, None), ("v", 0.5, 1.0)], "well string, dah double, val double")
    assert rows(models.regular(log, ["well"], "dah", ["val"], 1.0, max_hole=3.0)) == [("w", 0, 1.0), ("w", 1, 2.0), ("w", 2, 3.0), ("w", 7, 8.0)]
    assert rows(models.regular(log, ["well"], "dah", ["val"], 1.0))[3:5] == [("w", 3, 4.0), ("w", 4, 5.0)]
    assert models.regular(log.limit(0), ["well"], "dah", ["val"], 1.0).count() == 0


def test_spikes_keep_their_sum(spark):
    spikes = spark.createDataFrame([(1, 0.0, 2.0), (1, 3.0, 4.0), (1, 5.0, 1.0), (1, None, 7.0), (1, 1.0, None)], "trace int, t double, v double")
    assert rows(models.sampled_spikes(spikes, "trace", "t", "v", 4.0)) == [(1, 0, 3.0), (1, 1, 3.75), (1, 2, 0.25)]


def test_resampled_velocity(spark):
    cut = spark.createDataFrame([("a", 0.0, 3.0, 10.0), ("a", 3.0, 5.0, 20.0), ("a", 6.0, 6.0, 99.0), ("a", 5.0, 8.0, None)], "key string, top double, base double, vel double")
    assert rows(models.resampled_velocity(cut, "key", 2.0)) == [("a", 0, 10.0), ("a", 1, 15.0), ("a", 2, 20.0)]


def test_events(spark):
    trace = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.0, 3.0, 3.0, -1.0, 0.0])], "trace int, z_idx int, val double")
    assert rows(models.events(trace, 0.0)) == [(1, "peak", 1.5), (1, "trough", 3.3), (1, "zero", 2.75), (1, "zero", 4.0)]


def test_contour_skips_gaps(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 3.0), (0, 3, 0, 1.0), (0, 0, 1, 5.0)], "z int, inl int, crl int, val double")
    assert rows(models.contour(nodes, 2.0, ["z"])) == [(0, 0.0, 0.25), (0, 0.5, 0.0)]


def test_trim_statics_finds_shifts(spark):
    wave = [0.0, 0.0, 0.0, 1.0, 4.0, 9.0, 4.0, 1.0, 0.0, 0.0, 0.0]
    shifts = {1: 0, 2: 0, 3: 0, 4: 2, 5: -1}
    data = [(7, t, z, wave[(z - s) % len(wave)]) for t, s in shifts.items() for z in range(len(wave))]
    got = models.trim_statics(spark.createDataFrame(data, "gather int, trace int, z_idx int, val double"), 3)
    assert {t: s for _, t, s in got.collect()} == {t: -s for t, s in shifts.items()}


def test_generated_layers(spark):
    units = spark.createDataFrame([("sand", 10.0, 20.0)], "unit string, thickness_0 double, thickness_1 double")
    assert rows(models.generated_layers(units, 3, ["thickness"])) == [(0, "sand", 10.0), (1, "sand", 15.0), (2, "sand", 20.0)]
    assert rows(models.generated_layers(units, 1, ["thickness"])) == [(0, "sand", 15.0)]


def test_read_columns(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\n\n  1  well-A   10.5\n2\twell-B\t1e30\nx well-C\n")
    got = text.read_columns(spark, str(tmp_path / "t.txt"), {"id": (1, "int", 1.0), "name": (2, "string", 1.0), "z": (3, "double", 0.1)})
    assert rows(got) == [(1, "well-A", pytest.approx(1.05)), (2, "well-B", None), (None, "well-C", None)]


def test_parts_go_with_rows(spark):
    """Steps by model have more tasks as rows grow, fixed while they are few; the setting comes back."""
    from terrane.sources import tables

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.parts_for(spark, 10) == n and tables.parts_for(spark, 100 * n * tables.ROWS + 1) == 100 * n + 1
    with tables.more_parts(spark, 9 * n * tables.ROWS):
        assert spark.range(9).groupBy("id").count().repartition("id").count() == 9 and int(spark.conf.get("spark.sql.shuffle.partitions")) == 9 * n
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == n


def test_layers_are_dealt_by_rows(spark, monkeypatch):
    from terrane.plans import models as plans
    from terrane.sources import tables

    monkeypatch.setattr(tables, "ROWS", 500)
    layers = plans._layers(spark, "/root/testdata/sf0.001")
    assert layers.rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
