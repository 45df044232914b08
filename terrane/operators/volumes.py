"""Steps over volumes (inl, crl, z, val), horizons, gathers and wells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.graph import connected

CELL = ["inl", "crl", "z"]


def clamped(offset: int, key: str = "trace") -> Column:
    """The sample at an offset; beyond the ends, the first or last one."""
    w = Window.partitionBy(key).orderBy("z_idx")
    if offset == 0:
        return F.col("val")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.last("val").over(whole) if offset > 0 else F.first("val").over(whole)
    inside = F.lead("z_idx", offset).over(w) if offset > 0 else F.lag("z_idx", -offset).over(w)
    return F.when(inside.isNull(), edge).otherwise(F.lead("val", offset).over(w) if offset > 0 else F.lag("val", -offset).over(w))


def clamped_statistics(traces: DataFrame, half: int) -> DataFrame:
    """average and median (upper middle) of the gate around each sample, edge values repeated beyond the ends."""
    n = 2 * half + 1
    rows = traces.withColumn("gate", F.array(*[clamped(k) for k in range(-half, half + 1)]))
    total = F.aggregate("gate", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumns({"average": total / n, "median": F.element_at(F.array_sort("gate"), half + 1)}).drop("gate")


def threshold(volume: DataFrame, at: float, lower: float, upper: float) -> DataFrame:
    """val becomes `lower` below the threshold and `upper` from it on; undefined stays."""
    return volume.withColumn("val", F.when(F.col("val") < at, lower).when(F.col("val") >= at, upper))


def filled_between(volume: DataFrame, surfaces: DataFrame, top: float, gradient: float) -> DataFrame:
    """Inside [top_z, base_z] of surfaces (inl, top_z, base_z), val = top + (z - top_z) * gradient; outside it stays."""
    inside = F.col("z").between(F.col("top_z"), F.col("base_z"))
    value = F.when(inside, F.lit(top) + (F.col("z") - F.col("top_z")) * gradient).otherwise(F.col("val"))
    return volume.join(surfaces, "inl", "left").withColumn("val", value).select(volume.columns)


def in_body(inside: Column, value: float | None, outside: float | None, keep_inside: bool = False, keep_outside: bool = False) -> Column:
    """val filled by a body: inside and outside get a constant, undefined (None), or what was there."""
    one = F.col("val") if keep_inside else F.lit(value).cast("double")
    other = F.col("val") if keep_outside else F.lit(outside).cast("double")
    return F.when(inside, one).otherwise(other)


def body(operation: str, a: Column, b: Column) -> Column:
    """Bodies are positive inside: union, intersection or minus of two of them."""
    return {"union": F.greatest(a, b), "intersection": F.least(a, b), "minus": F.least(a, -b)}[operation]


def voxel_components(volume: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """component (its least cell number) and size of the cells in [low, high] that hang together through faces; components
    smaller than `least` are left out. Cells number inl * 2^40 + crl * 2^20 + z, so crl and z stay below 2^20."""
    node = F.shiftleft(F.col("inl").cast("long"), 40) + F.shiftleft(F.col("crl").cast("long"), 20) + F.col("z")
    cells = volume.where(F.col("val").between(low, high)).select(*CELL, node.alias("node"))
    steps = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 1 << 20, 1 << 40)]))
    other = cells.select(F.col("node").alias("v"))
    edges = cells.select(F.col("node").alias("u"), steps.alias("step")).withColumn("v", F.col("u") + F.col("step")).join(other, "v").select("u", "v")
    found = connected(edges)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return cells.join(found, "node").join(sizes, "component").select(*CELL, "component", "size")


def semivariance(volume: DataFrame, along: str, lags: int) -> DataFrame:
    """lag, n, gamma: half the mean squared difference of cells so many steps apart along inl, crl or z. Cells meet by
    equality of their position, one join for all lags."""
    rest = [c for c in CELL if c != along]
    ahead = volume.select(*rest, (F.col(along)).alias("to"), F.col("val").alias("other"))
    moved = volume.select(*rest, F.col("val"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col(along)).withColumn("to", F.col(along) + F.col("lag"))
    d = F.col("val") - F.col("other")
    return moved.join(ahead, [*rest, "to"]).groupBy("lag").agg(F.count(d).alias("n"), (F.avg(d * d) / 2).alias("gamma"))


def variogram(model: str, lag: Column, reach: float, sill: float, nugget: float) -> Column:
    """(sill - nugget) * f(lag / reach) + nugget by the exponential, gaussian or spherical model."""
    h = lag / reach
    f = {
        "exponential": 1 - F.exp(-3 * h),
        "gaussian": 1 - F.exp(-3 * h * h),
        "spherical": F.when(h >= 1, 1.0).otherwise(1.5 * h - 0.5 * h * h * h),
    }[model]
    return (sill - nugget) * f + nugget


def plane(rows: DataFrame, key: str, x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a0 + ax x + ay y of each key, from centred second moments; undefined if points are in a line."""
    v = lambda a, b: F.covar_pop(a, b)
    g = rows.groupBy(key).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate((x, y, z))], v(x, x).alias("xx"), v(x, y).alias("xy"), v(y, y).alias("yy"), v(x, z).alias("xz"), v(y, z).alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    det = F.when(F.abs(det) > 1e-9 * F.col("xx") * F.col("yy"), det)
    g = g.withColumns({"ax": (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, "ay": (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det})
    return g.select(key, (F.col("m2") - F.col("ax") * F.col("m0") - F.col("ay") * F.col("m1")).alias("a0"), "ax", "ay")


def principal_components(vectors: DataFrame, column: str) -> DataFrame:
    """component (from 1), eigenvalue, share, direction of the sample covariance of vectors of one length; null vectors, and
    those with an undefined component, are left out. Tasks add up moments of their rows (d * d numbers, whatever the number
    of rows), these are summed, and one task solves the d-by-d problem."""
    schema = "n double, s array<double>, m array<double>"

    def moments(frames):
        n, s, m = 0, 0.0, 0.0
        for frame in frames:
            rows = [np.asarray(x, float) for x in frame[column] if x is not None]
            rows = [x for x in rows if np.isfinite(x).all()]
            if rows:
                x = np.stack(rows)
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        if n:
            yield pd.DataFrame({"n": [float(n)], "s": [s], "m": [m.ravel()]})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n, s = frame["n"].sum(), np.sum(np.stack(frame["s"]), 0)
        m = np.sum(np.stack(frame["m"]), 0).reshape(len(s), -1)
        values, directions = np.linalg.eigh((m - np.outer(s, s) / n) / max(n - 1, 1))
        values, directions = values[::-1], directions[:, ::-1].T
        directions = directions * np.where(directions[np.arange(len(s)), np.abs(directions).argmax(1)] < 0, -1, 1)[:, None]
        return pd.DataFrame({"component": np.arange(1, len(s) + 1), "eigenvalue": values, "share": values / max(values.sum(), 1e-300), "direction": list(directions)})

    parts = vectors.select(column).mapInPandas(moments, schema)
    # partial sums meet in 64 groups first, so the last one holds 64 rows at most
    add = lambda g: pd.DataFrame({"n": [g["n"].sum()], "s": [np.sum(np.stack(g["s"]), 0)], "m": [np.sum(np.stack(g["m"]), 0)]})
    parts = parts.withColumn("g", F.spark_partition_id() % 64).groupBy("g").applyInPandas(add, schema)
    return parts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "component int, eigenvalue double, share double, direction array<double>")


# ---- gathers and velocities


def muted(amplitude: Column, z: Column, mute: Column, taper: float, tail: bool = False) -> Column:
    """0 above the mute (outer) or below it (tail), rising linearly over `taper`."""
    x = (mute - z if tail else z - mute) / taper
    return amplitude * F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def incidence_angle(offset: Column, depth: Column) -> Column:
    """Angle in degrees of a straight ray to a reflector at depth."""
    return F.degrees(F.atan2(offset / 2, depth))


def gather_agc(gathers: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """agc: amplitudes over the RMS of their gate along z, in each trace of a gather."""
    w = Window.partitionBy(*keys).orderBy("z", "val").rowsBetween(first, last)
    level = F.sqrt(F.avg(F.col("val") * F.col("val")).over(w))
    return gathers.withColumn("agc", F.when(level > 0, F.col("val") / level).otherwise(0.0))


# ---- wells


def minimum_curvature(surveys: DataFrame) -> DataFrame:
    """x, y, tvd along wells (well, md, incl, azi in degrees) from the station before by the ratio factor of the dogleg;
    the first station is the origin."""
    w = Window.partitionBy("well").orderBy("md")
    i, a = F.radians("incl"), F.radians("azi")
    rows = surveys.withColumns({"i": i, "a": a}).withColumns({"i0": F.lag("i").over(w), "a0": F.lag("a").over(w), "d": F.col("md") - F.lag("md").over(w)})
    cosine = F.cos(F.col("i") - F.col("i0")) - F.sin("i0") * F.sin("i") * (1 - F.cos(F.col("a") - F.col("a0")))
    rows = rows.withColumn("bend", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))
    rf = F.when(F.col("bend") < 1e-6, 1.0).otherwise(2 / F.col("bend") * F.tan(F.col("bend") / 2))
    half = F.col("d") / 2 * rf
    step = {
        "x": half * (F.sin("i0") * F.sin("a0") + F.sin("i") * F.sin("a")),
        "y": half * (F.sin("i0") * F.cos("a0") + F.sin("i") * F.cos("a")),
        "tvd": half * (F.cos("i0") + F.cos("i")),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in step.items()}).select("well", "md", *[F.sum(k).over(w).alias(k) for k in step])


def zones(markers: DataFrame) -> DataFrame:
    """Markers (well, marker, dah) as zones: each reaches to the next one down; the last has no base."""
    w = Window.partitionBy("well").orderBy("dah", "marker")
    base = F.lead("dah").over(w)
    return markers.select("well", "marker", F.col("dah").alias("top"), base.alias("base"), (base - F.col("dah")).alias("thickness"))


def backus(layers: DataFrame, key: str) -> DataFrame:
    """Layers (thickness, vel, den) blocked: density by thickness, velocity by the harmonic mean of the moduli den * vel^2."""
    t = F.col("thickness")
    g = layers.groupBy(key).agg(F.sum(t).alias("thickness"), F.sum(t * F.col("den")).alias("mass"), F.sum(t / (F.col("den") * F.col("vel") ** 2)).alias("soft"))
    den = F.col("mass") / F.col("thickness")
    return g.select(key, "thickness", den.alias("den"), F.sqrt(F.col("thickness") / F.col("soft") / den).alias("vel"))


# ---- positions


def affine(x: Column, y: Column, origin: tuple[float, float], inl: tuple[float, float], crl: tuple[float, float]) -> tuple[Column, Column]:
    """Bin numbers of coordinates: the inverse of xy = origin + i * inl + c * crl."""
    det = inl[0] * crl[1] - crl[0] * inl[1]
    dx, dy = x - origin[0], y - origin[1]
    return (dx * crl[1] - dy * crl[0]) / det, (dy * inl[0] - dx * inl[1]) / det


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each class as the rarest has, the least by hash of key: sizes are counted first, then each class is
    ranked. A sampling operator: the rows it leaves out are its purpose."""
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    least = sizes.agg(F.min("size").alias("least"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.where(F.col(label).isNotNull()).withColumn("rank", rank).join(F.broadcast(least), F.col("rank") <= F.col("least")).drop("rank", "least")
