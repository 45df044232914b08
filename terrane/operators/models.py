"""Layer models, time-depth relations, regular sampling, contours and statics.

What lies between two neighbouring samples is made from those two alone: the regular positions of an interval are exploded
from the row of its first sample, so that no row is paired with others by a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- reflection and rays


def zoeppritz(vp1: Column, vs1: Column, rho1: Column, vp2: Column, vs2: Column, rho2: Column, angle: Column) -> Column:
    """The plane-wave PP reflection coefficient at an angle of incidence (radians), by Aki and Richards' solution of the
    four boundary conditions. Null from the critical angle on, where it is not real, and where a property is null."""
    p = F.sin(angle) / vp1
    cosine = lambda v: F.sqrt(F.when(p * v < 1, 1 - p * p * v * v))
    q1, q2, s1, s2 = cosine(vp1) / vp1, cosine(vp2) / vp2, cosine(vs1) / vs1, cosine(vs2) / vs2
    m1, m2 = rho1 * vs1 * vs1 * p * p, rho2 * vs2 * vs2 * p * p
    a, b, c = rho2 - 2 * m2 - rho1 + 2 * m1, rho2 - 2 * m2 + 2 * m1, rho1 - 2 * m1 + 2 * m2
    d = 2 * (rho2 * vs2 * vs2 - rho1 * vs1 * vs1)
    e, f, g, h = b * q1 + c * q2, b * s1 + c * s2, a - d * q1 * s2, a - d * q2 * s1
    return F.try_divide((b * q1 - c * q2) * f - (a + d * q1 * s2) * h * p * p, e * f + g * h * p * p)


def below(layers: DataFrame, columns: list[str], key: str = "model", order: str = "layer") -> DataFrame:
    """next_<column>: the same of the layer below; null for the deepest."""
    w = Window.partitionBy(key).orderBy(order)
    return layers.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def rays(layers: DataFrame, offsets: list[float]) -> DataFrame:
    """For the base of each of the layers (model, layer, thickness, vp) and each offset: two-way time at zero offset t0, RMS
    velocity, time twt by normal moveout, and angle of incidence in radians (null where its sine would exceed 1)."""
    w = Window.partitionBy("model").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    dt = 2 * F.col("thickness") / F.col("vp")
    rows = layers.withColumns({"t0": F.sum(dt).over(w), "e": F.sum(dt * F.col("vp") * F.col("vp")).over(w)})
    rows = rows.withColumn("vrms", F.sqrt(F.try_divide(F.col("e"), F.col("t0")))).withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    rows = rows.withColumn("twt", F.sqrt(F.col("t0") ** 2 + (F.col("offset") / F.col("vrms")) ** 2))
    sine = F.try_divide(F.col("offset") * F.col("vp"), F.col("vrms") * F.col("vrms") * F.col("twt"))
    return rows.withColumn("angle", F.asin(F.when(sine <= 1, sine))).drop("e")


def sampled_spikes(spikes: DataFrame, key: str, time: str, value: str, step: float) -> DataFrame:
    """key, sample, value: spikes at any time, each shared out to the two samples around it by distance; samples that no
    spike reaches have no row. Spikes of null time or value count for nothing."""
    at = F.col(time) / step
    low, part = F.floor(at), at - F.floor(at)
    two = F.array(F.struct(low.alias("k"), (1 - part).alias("w")), F.struct((low + 1).alias("k"), part.alias("w")))
    rows = spikes.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, value, F.explode(two).alias("s")).where("s.w > 0")
    return rows.groupBy(key, F.col("s.k").alias("sample")).agg(F.sum(F.col(value) * F.col("s.w")).alias(value))


def generated_layers(units: DataFrame, models: int, properties: list[str]) -> DataFrame:
    """model, unit and properties: models from 0 to models - 1, in which each property goes evenly from <property>_0 to
    <property>_1; a single model has the means."""
    rows = units.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    part = F.col("model") / float(models - 1) if models > 1 else F.lit(0.5)
    return rows.select("model", "unit", *[(F.col(f"{p}_0") + (F.col(f"{p}_1") - F.col(f"{p}_0")) * part).alias(p) for p in properties])


# ---- regular sampling


def regular(rows: DataFrame, keys: list[str], at: str, values: list[str], step: float, max_hole: float | None = None) -> DataFrame:
    """keys, k and values at at = k * step, linear between neighbouring samples. Nothing lies outside of the samples, and
    nothing strictly inside a hole wider than max_hole. Samples with a null position or value are left out first; of those
    of one position the least values count."""
    rows = rows.where(F.concat(*[F.col(c).cast("string") for c in [at, *values]]).isNotNull()).groupBy(*keys, at).agg(*[F.min(c).alias(c) for c in values])
    w = Window.partitionBy(*keys).orderBy(at)
    here, there = F.col(at).cast("double"), F.lead(F.col(at).cast("double")).over(w)
    rows = rows.select(*keys, here.alias("_a"), there.alias("_b"), *values, *[F.lead(c).over(w).alias(f"_{c}") for c in values])
    first, last = F.ceil(F.col("_a") / step), F.when(F.col("_b").isNull(), F.floor(F.col("_a") / step)).otherwise(F.ceil(F.col("_b") / step) - 1)
    rows = rows.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    part = F.coalesce((F.col("k") * step - F.col("_a")) / (F.col("_b") - F.col("_a")), F.lit(0.0))
    if max_hole is not None:
        rows = rows.where(F.col("_b").isNull() | (F.col("_b") - F.col("_a") <= max_hole) | (F.col("k") * step == F.col("_a")))
    return rows.select(*keys, "k", *[(F.col(c) + part * (F.coalesce(f"_{c}", c) - F.col(c))).alias(c) for c in values])


def stretched(traces: DataFrame, step: float) -> DataFrame:
    """trace, k, val at depth k * step, of traces (trace, z_idx, val, depth) whose depth rises with z_idx."""
    return regular(traces, ["trace"], "depth", ["val"], step)


def resampled_velocity(intervals: DataFrame, key: str, step: float) -> DataFrame:
    """key, k, vel: the mean velocity between k * step and (k + 1) * step of intervals (key, top, base, vel) of constant
    velocity, each weighted by what it covers; a cell that is covered in part has the mean of that part."""
    rows = intervals.where("base > top AND vel IS NOT NULL").withColumn("k", F.explode(F.sequence(F.floor(F.col("top") / step), F.ceil(F.col("base") / step) - 1)))
    cover = F.least("base", (F.col("k") + 1) * step) - F.greatest("top", F.col("k") * step)
    return rows.groupBy(key, "k").agg((F.sum(F.col("vel") * cover) / F.sum(cover)).alias("vel"))


# ---- events, contours and statics


def events(traces: DataFrame, level: float = 0.0) -> DataFrame:
    """trace, kind, at: extremes ("peak", "trough") by the parabola through three samples, and crossings of a level ("zero")
    by the line through two. Equal neighbours make an extreme at their first sample; a sample on the level is a crossing
    of the interval that it ends."""
    w = Window.partitionBy("trace").orderBy("z_idx")
    a, v, b, z = F.lag("val").over(w), F.col("val"), F.lead("val").over(w), F.col("z_idx")
    rows = traces.select("trace", z.alias("z"), a.alias("a"), v.alias("v"), b.alias("b"))
    a, v, b, z = (F.col(c) for c in ("a", "v", "b", "z"))
    top = F.when((v > a) & (v >= b), "peak").when((v < a) & (v <= b), "trough")
    bend = F.struct(top.alias("kind"), (z + 0.5 * (a - b) / (a - 2 * v + b)).alias("at"))
    cross = F.when((a < level) != (v < level), F.struct(F.lit("zero").alias("kind"), (z - 1 + (level - a) / (v - a)).alias("at")))
    found = F.filter(F.array(F.when(top.isNotNull(), bend), cross), lambda e: e.isNotNull())
    return rows.select("trace", F.explode(found).alias("e")).select("trace", "e.kind", "e.at")


def contour(grid: DataFrame, level: float, by: list[str]) -> DataFrame:
    """by, x, y: where a contour crosses the lines between neighbouring nodes (inl, crl, val), by linear interpolation."""
    out = None
    for along, across in (("inl", "crl"), ("crl", "inl")):
        w = Window.partitionBy(*by, across).orderBy(along)
        rows = grid.select(*by, "inl", "crl", "val", F.lead("val").over(w).alias("v"), F.lead(along).over(w).alias("n"))
        rows = rows.where((F.col("n") == F.col(along) + 1) & ((F.col("val") < level) != (F.col("v") < level)))
        shift = (level - F.col("val")) / (F.col("v") - F.col("val"))
        at = {c: F.col(c) + (shift if c == along else F.lit(0.0)) for c in ("inl", "crl")}
        rows = rows.select(*by, at["inl"].alias("x"), at["crl"].alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return out


def trim_statics(gathers: DataFrame, most: int) -> DataFrame:
    """gather, trace, shift: the shift of at most `most` samples that makes a trace most like its gather's mean trace (the
    greatest sum of products; the least shift by size, then by sign, on a tie)."""
    pilot = gathers.groupBy("gather", "z_idx").agg(F.avg("val").alias("pilot"))
    rows = gathers.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("z_idx", F.col("z_idx") + F.col("shift"))
    scores = rows.join(pilot, ["gather", "z_idx"]).groupBy("gather", "trace", "shift").agg(F.round(F.sum(F.col("val") * F.col("pilot")), 6).alias("score"))
    return scores.groupBy("gather", "trace").agg(F.max_by("shift", F.struct("score", -F.abs("shift"), -F.col("shift"))).alias("shift"))
