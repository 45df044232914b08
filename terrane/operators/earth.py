"""Horizons, wells, velocities, layers and rock physics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crossings(horizons: DataFrame) -> DataFrame:
    """For each pair of horizons (hor, pos, z): at how many positions the first lies above, and below, and by how much in all."""
    a = horizons.select("pos", F.col("hor").alias("a"), F.col("z").alias("za"))
    b = horizons.select("pos", F.col("hor").alias("b"), F.col("z").alias("zb"))
    d = F.col("zb") - F.col("za")
    return a.join(b, "pos").where("a < b AND za != zb").groupBy("a", "b").agg(
        F.count(F.when(d > 0, 1)).alias("above"), F.count(F.when(d < 0, 1)).alias("below"), F.sum(F.when(d > 0, d).otherwise(0.0)).alias("sum_above"), F.sum(F.when(d < 0, d).otherwise(0.0)).alias("sum_below")
    )


def isochron(top: DataFrame, base: DataFrame, signed: bool = True) -> DataFrame:
    d = F.col("z2") - F.col("z1")
    return top.select("pos", F.col("z").alias("z1")).join(base.select("pos", F.col("z").alias("z2")), "pos", "left").select("pos", (d if signed else F.abs(d)).alias("isochron"))


def merged(horizons: DataFrame, how: str) -> DataFrame:
    return horizons.groupBy("pos").agg({"average": F.avg, "top": F.min, "base": F.max}[how]("z").alias("z"))


def curvature(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each surface of grid (inl, crl, z; `by` tells surfaces apart): mean and Gaussian curvature and dip of the quadric through the nine z values around a cell of unit spacing; undefined
    if one of the nine is."""
    at = [(i, c) for i in (-1, 0, 1) for c in (-1, 0, 1)]
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in at]))
    by = by or []
    moved = grid.where("z IS NOT NULL").select(*by, "inl", "crl", "z", shift.alias("s")).select(*by, (F.col("inl") - F.col("s.i")).alias("inl"), (F.col("crl") - F.col("s.c")).alias("crl"), "s", "z")
    nine = moved.groupBy(*by, "inl", "crl").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when((F.col("s.i") == i) & (F.col("s.c") == c), F.col("z"))).alias(f"z{k}") for k, (i, c) in enumerate(at)]).where("n = 9")
    z = [F.col(f"z{k}") for k in range(9)]
    a = (z[0] + z[1] + z[2] + z[6] + z[7] + z[8]) / 6 - (z[3] + z[4] + z[5]) / 3
    b = (z[0] + z[2] + z[3] + z[5] + z[6] + z[8]) / 6 - (z[1] + z[4] + z[7]) / 3
    c = (z[0] + z[8] - z[2] - z[6]) / 4
    d = (z[6] + z[7] + z[8] - z[0] - z[1] - z[2]) / 6
    e = (z[2] + z[5] + z[8] - z[0] - z[3] - z[6]) / 6
    s = 1 + d * d + e * e
    mean = (a * (1 + e * e) + b * (1 + d * d) - c * d * e) / F.pow(s, 1.5)
    gauss = (4 * a * b - c * c) / (s * s)
    return nine.select(*by, "inl", "crl", mean.alias("mean_curvature"), gauss.alias("gauss_curvature"), F.atan(F.sqrt(d * d + e * e)).alias("dip"))


def dix(functions: DataFrame, order: str = "t") -> DataFrame:
    """Interval velocities of RMS velocities (key, t, vrms) at layer bottoms, the first layer starting at 0."""
    w = Window.partitionBy("key").orderBy(order)
    e, t = F.col("vrms") * F.col("vrms") * F.col("t"), F.col("t")
    above, before = F.coalesce(F.lag(e).over(w), F.lit(0.0)), F.coalesce(F.lag(t).over(w), F.lit(0.0))
    square = (e - above) / F.nullif(t - before, F.lit(0.0))
    return functions.withColumn("vint", F.when(square >= 0, F.sqrt(square)))


def rms_velocity(functions: DataFrame) -> DataFrame:
    """RMS and average velocity and depth of interval velocities (key, t: layer bottoms in two-way time, vint)."""
    w = Window.partitionBy("key").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = functions.withColumn("dt", F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0)))
    v, dt, t = F.col("vint"), F.col("dt"), F.col("t")
    return rows.select("key", "t", F.sqrt(F.sum(v * v * dt).over(run) / F.nullif(t, F.lit(0.0))).alias("vrms"), (F.sum(v * dt).over(run) / F.nullif(t, F.lit(0.0))).alias("vavg"), (F.sum(v * dt / 2).over(run)).alias("depth"))


def moveout(t0: Column, offset: Column, velocity: Column) -> Column:
    return F.sqrt(t0 * t0 + offset * offset / (velocity * velocity))


def linear_depth(t: Column, v0: float, k: float) -> Column:
    """Depth of two-way time t where velocity is v0 + k * depth."""
    return F.lit(v0) * (F.exp(F.lit(k) * t / 2) - 1) / k


def linear_time(z: Column, v0: float, k: float) -> Column:
    return 2 * F.log(1 + F.lit(k) * z / v0) / k


def reflectivity(layers: DataFrame) -> DataFrame:
    """Acoustic reflection at the bottom of each layer (model, layer, ai)."""
    below = F.lead("ai").over(Window.partitionBy("model").orderBy("layer"))
    return layers.withColumn("reflectivity", (below - F.col("ai")) / F.nullif(below + F.col("ai"), F.lit(0.0)))


def layer_tops(layers: DataFrame) -> DataFrame:
    """ztop and zbase of layers (model, layer, thickness) from 0 down."""
    run = Window.partitionBy("model").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    base = F.sum("thickness").over(run)
    return layers.withColumns({"ztop": base - F.col("thickness"), "zbase": base})


def at_depth(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of a log (well, dah, val) at wanted depths (well, at), linear between its samples.

    Both are laid in one order by depth; the samples before and after come by window, so nothing is paired."""
    rows = log.where("val IS NOT NULL").select("well", F.col("dah").cast("double").alias("d"), "val", F.lit(0).alias("q")).unionByName(wanted.select("well", F.col("at").cast("double").alias("d"), F.lit(None).cast("double").alias("val"), F.lit(1).alias("q")))
    w = Window.partitionBy("well")
    back, ahead = (w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("d", "q"), (F.desc("d"), F.desc("q"))))
    sample = F.when(F.col("q") == 0, F.struct("d", "val"))
    rows = rows.withColumns({"lo": F.last(sample, True).over(back), "hi": F.last(sample, True).over(ahead)}).where("q = 1")
    lo, hi, d = F.col("lo"), F.col("hi"), F.col("d")
    lerp = lo["val"] + (hi["val"] - lo["val"]) * (d - lo["d"]) / F.nullif(hi["d"] - lo["d"], F.lit(0.0))
    return rows.select("well", d.alias("at"), F.when(d == lo["d"], lo["val"]).when(d == hi["d"], hi["val"]).otherwise(lerp).alias("val"))


def gaussian(x: Column, mean: Column, sd: Column) -> Column:
    """exp(-z^2 / 2) / sqrt(2 pi), z = (x - mean) / sd, without the factor 1 / sd."""
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / F.sqrt(2 * F.pi())


def classify(points: DataFrame, classes: list[tuple[float, float, float]], value: str) -> DataFrame:
    """The class (from 1) of greatest density times prior among (mean, sd, prior); the first on a tie; -1 if all vanish.
    confidence: how far the winner leads the next, as a share of its own."""
    p = [gaussian(F.col(value), F.lit(m), F.lit(s)) * F.lit(w) for m, s, w in classes]
    names = [f"p{k}" for k in range(1, len(p) + 1)]
    rows = points.withColumns(dict(zip(names, p, strict=True)))
    best, second = F.greatest(*names), F.sort_array(F.array(*names), False)[1]
    which = F.array_position(F.array(*names), best).cast("int")
    return rows.withColumns({"cls": F.when(best < 1e-20, -1).otherwise(which), "confidence": F.when(best < 1e-20, 0.0).otherwise((best - second) / best)}).drop(*names)
