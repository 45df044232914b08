"""Attributes of traces in long form: one row for each sample, keyed by trace, ordered by z_idx, with the value val."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from terrane.functions import stats

def v() -> Column:
    return F.col("val")


def along(key: str = "trace") -> WindowSpec:
    return Window.partitionBy(key).orderBy("z_idx")


def gate(first: int, last: int, key: str = "trace") -> WindowSpec:
    return along(key).rowsBetween(first, last)


def complete(value: Column, frame: WindowSpec, size: int) -> Column:
    """value where the frame has all its samples ("required" margins); else undefined."""
    return F.when(F.count(F.lit(1)).over(frame) == size, value)


def energy(traces: DataFrame, first: int, last: int, value: Column | None = None) -> DataFrame:
    """Energy of a gate over its full size, its root and its logarithm; partial gates at the ends count."""
    value = v() if value is None else value
    e = F.sum(value * value).over(gate(first, last)) / F.lit(last - first + 1)
    return traces.withColumns({"energy": e, "root": F.sqrt(e), "log": F.when(e > 0, F.log(e))})


def gradient(value: Column | None = None, order: WindowSpec | None = None) -> Column:
    """Half the difference of both neighbours; that to the only one at an end."""
    order = order or along()
    value = v() if value is None else value
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    return F.when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)


def agc(traces: DataFrame, first: int, last: int) -> DataFrame:
    """Value over the root of the mean energy of its gate; 0 where that is 0."""
    level = F.sqrt(F.avg(v() * v()).over(gate(first, last)))
    return traces.withColumn("agc", F.when(v().isNull(), None).when(level == 0, 0.0).otherwise(v() / level))


def detrend(traces: DataFrame) -> DataFrame:
    """Value less the least-squares line of its trace."""
    whole = Window.partitionBy("trace")
    z = F.col("z_idx").cast("double")
    slope = F.coalesce(F.covar_pop(v(), z).over(whole) / F.nullif(F.var_pop(z).over(whole), F.lit(0.0)), F.lit(0.0))
    return traces.withColumn("detrended", v() - F.avg(v()).over(whole) - slope * (z - F.avg(z).over(whole)))


def despike(traces: DataFrame, first: int, last: int, cutoff: float) -> DataFrame:
    """One pass: values further than cutoff population deviations from the mean of their gate become that mean."""
    g = gate(first, last)
    mean, sd = F.avg(v()).over(g), F.stddev_pop(v()).over(g)
    return traces.withColumn("despiked", F.when((sd > 0) & (F.abs(v() - mean) / sd > cutoff), mean).otherwise(v()))


def convolved(traces: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted sum of the samples around (odd number of weights), over the weights' sum unless that is 0; whole kernels only."""
    half, total = len(weights) // 2, sum(weights)
    parts = [(F.lag(v(), half - i) if i < half else F.lead(v(), i - half) if i > half else v()) for i in range(len(weights))]
    terms = [(p.over(along()) if i != half else p) * F.lit(float(w)) for i, (p, w) in enumerate(zip(parts, weights, strict=True))]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return traces.withColumn("convolved", out / F.lit(float(total or 1)))


def instantaneous(traces: DataFrame) -> DataFrame:
    """Amplitude, phase, cosine of phase and sweetness of value and quadrature trace (imag), dz = 1."""
    re, im = F.col("val"), F.col("imag")
    phase = F.atan2(im, re)
    d = (F.lead(phase).over(along()) - F.lag(phase).over(along()))
    freq = F.when(d < 0, d + 2 * F.pi()).otherwise(d) / (4 * F.pi())
    amp = F.sqrt(re * re + im * im)
    return traces.select("trace", "z_idx", amp.alias("amplitude"), phase.alias("phase"), freq.alias("frequency"), F.when(freq > 0, amp / F.sqrt(freq)).otherwise(F.when(freq.isNotNull(), 0.0)).alias("sweetness"))


def similarity(pairs: DataFrame, first: int, last: int) -> DataFrame:
    """1 - |a - b| / (|a| + |b|) over a gate, for pairs of traces side by side (pair, z_idx, a, b); 1 where both are still, 0
    where one is; whole gates only."""
    g, a, b = gate(first, last, "pair"), F.col("a"), F.col("b")
    d, ea, eb = (F.sqrt(F.sum(x * x).over(g)) for x in (a - b, a, b))
    value = F.when((ea == 0) & (eb == 0), 1.0).when((ea == 0) | (eb == 0), 0.0).otherwise(1 - d / (ea + eb))
    return pairs.withColumn("similarity", complete(value, g, last - first + 1))


def grey_levels(traces: DataFrame, levels: int, low: float, high: float) -> DataFrame:
    """Co-occurrence measures of successive samples' grey levels in each trace: contrast, homogeneity, energy, entropy."""
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor((v() - low) * (levels - 1) / (high - low)))).cast("int")
    steps = traces.withColumn("m", level).withColumn("n", F.lead(level).over(along())).where("n IS NOT NULL")
    both = steps.select("trace", "m", "n").unionAll(steps.select("trace", F.col("n").alias("m"), F.col("m").alias("n")))
    share = both.groupBy("trace", "m", "n").agg(F.count(F.lit(1)).alias("c"))
    share = share.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("trace")))
    d, p = F.col("m") - F.col("n"), F.col("p")
    return share.groupBy("trace").agg(F.sum(p * d * d).alias("contrast"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * p).alias("asm"), (-F.sum(p * F.log(p))).alias("entropy"))


def window_statistic(traces: DataFrame, name: str, first: int, last: int) -> DataFrame:
    frame = gate(first, last)
    builders = {"average": F.avg(v()).over(frame), "sum": F.sum(v()).over(frame), "min": F.min(v()).over(frame), "max": F.max(v()).over(frame), "rms": F.sqrt(F.avg(v() * v()).over(frame)), "variance": F.coalesce(F.when(F.count(v()).over(frame) > 1, F.var_samp(v()).over(frame)), F.lit(0.0))}
    return traces.withColumn(name, builders[name])


def neighbourhood(grid: DataFrame, di: int, dc: int) -> DataFrame:
    """Every cell (inl, crl, z) beside each cell of its rectangle: near, the neighbour's value. Cells are replicated by the
    size of the rectangle and meet by position, so no cell's neighbours are gathered in one place."""
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i in range(-di, di + 1) for c in range(-dc, dc + 1)]))
    moved = grid.select("*", shifts.alias("s")).select((F.col("inl") + F.col("s.i")).alias("inl"), (F.col("crl") + F.col("s.c")).alias("crl"), "z", v().alias("near"))
    return grid.join(moved, ["inl", "crl", "z"])


def volume_statistics(grid: DataFrame, di: int, dc: int) -> DataFrame:
    """Statistics of the defined values of the rectangle of cells around each cell that has a value."""
    near = F.col("near")
    return neighbourhood(grid.where("val IS NOT NULL"), di, dc).groupBy("inl", "crl", "z").agg(
        F.count(near).alias("n"), F.avg(near).alias("average"), F.min(near).alias("low"), F.max(near).alias("high"), stats.rms(near).alias("rms"), stats.variance(near).alias("variance"), stats.extreme(near).alias("extreme")
    )


def semblance(grid: DataFrame, di: int, dc: int) -> DataFrame:
    """Squared sum over n times the sum of squares of the rectangle around each cell; undefined where all is 0."""
    near = F.col("near")
    return neighbourhood(grid.where("val IS NOT NULL"), di, dc).groupBy("inl", "crl", "z").agg((F.sum(near) * F.sum(near) / F.nullif(F.count(near) * F.sum(near * near), F.lit(0.0))).alias("semblance"))


def normalised(traces: DataFrame) -> DataFrame:
    """centred: value less its trace's mean. scaled: the trace's range, taken without its last sample, to [-1, 1]; 0 without a range."""
    whole = Window.partitionBy("trace")
    inner = F.when(F.col("z_idx") < F.col("last"), v())
    rows = traces.withColumn("last", F.max("z_idx").over(whole)).withColumns({"low": F.min(inner).over(whole), "high": F.max(inner).over(whole)})
    scaled = F.when(F.col("high") > F.col("low"), (v() - F.col("low")) * 2 / (F.col("high") - F.col("low")) - 1).otherwise(0.0)
    return rows.withColumns({"centred": v() - F.avg(v()).over(whole), "scaled": scaled}).drop("last", "low", "high")


def correlation(pairs: DataFrame) -> DataFrame:
    """Sum of products over the root of both energies, for pairs (trace, z_idx, a, b); undefined where either is still or any
    sample is undefined."""
    a, b = F.col("a"), F.col("b")
    value = F.sum(a * b) / F.nullif(F.sqrt(F.sum(a * a) * F.sum(b * b)), F.lit(0.0))
    return pairs.groupBy("trace").agg(F.when(F.count(F.lit(1)) == F.count(a * b), value).alias("correlation"))


def outer_mutes(gathers: DataFrame) -> DataFrame:
    """The last sample before each trace's first that is not 0, never deeper at a near offset (crl) than at a farther one of
    its gather (inl); a trace of zeros takes what the farther ones have."""
    top = gathers.groupBy("inl", "crl").agg((F.min(F.when(v() != 0, F.col("z"))) - 1).alias("top"))
    from_far = Window.partitionBy("inl").orderBy(F.desc("crl")).rowsBetween(Window.unboundedPreceding, 0)
    return top.select("inl", "crl", F.min("top").over(from_far).alias("mute"))


def lateral_smooth(grid: DataFrame, di: int, dc: int) -> DataFrame:
    """Median and mean of the rectangle around each cell, slice by slice."""
    return neighbourhood(grid, di, dc).groupBy("inl", "crl", "z").agg(F.median("near").alias("median"), F.avg("near").alias("mean"))


def fill_inverse_distance(grid: DataFrame, radius: int, least: int) -> DataFrame:
    """Cells without a value that have `least` valued cells or more within the radius: their mean by 1 / distance squared."""
    known = grid.where("val IS NOT NULL")
    around = [(i, c) for i in range(-radius, radius + 1) for c in range(-radius, radius + 1) if 0 < i * i + c * c <= radius * radius]
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(1.0 / (i * i + c * c)).alias("w")) for i, c in around]))
    moved = known.select("*", shifts.alias("s")).select((F.col("inl") + F.col("s.i")).alias("inl"), (F.col("crl") + F.col("s.c")).alias("crl"), "z", "val", "s.w")
    filled = moved.groupBy("inl", "crl", "z").agg((F.sum(v() * F.col("w")) / F.sum("w")).alias("filled"), F.count(F.lit(1)).alias("n"))
    return filled.where(F.col("n") >= least).join(known, ["inl", "crl", "z"], "left_anti")


def merge_stack(cubes: DataFrame) -> DataFrame:
    """The traces (cube, inl, crl) at one position averaged sample by sample; those of zeros alone count only where all are."""
    live = F.max(F.abs(v())).over(Window.partitionBy("cube", "inl", "crl")) > 0
    rows = cubes.withColumn("live", F.coalesce(live, F.lit(False))).withColumn("some", F.max("live").over(Window.partitionBy("inl", "crl")))
    return rows.where("live OR NOT some").groupBy("inl", "crl", "z").agg(F.avg(v()).alias("val"))
