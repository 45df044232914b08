"""Values of single rows and small groups: scalers, angles, text tests, rock physics, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(kind: str, v: Column, a: float = 0.0, b: float = 1.0) -> Column:
    """linear: a + b v; log: of v above 0, base 10; exp: of v; asymptotic: v into (-1, 1)."""
    return {
        "linear": a + b * v,
        "log": F.when(v > 0, F.log10(v)),
        "exp": F.exp(v),
        "asymptotic": v / (1 + F.abs(v)),
    }[kind]


def squeezed(v: Column, low: float | None, high: float | None, keep_low: float | None = None, keep_high: float | None = None) -> Column:
    """v brought between low and high (either may be missing): cut off there, or, from keep_low down and keep_high up, bent
    smoothly towards them. What is kept must lie inside; undefined values stay so."""
    out = v
    if low is not None:
        w = None if keep_low is None or keep_low <= low else low - keep_low
        out = F.greatest(out, F.lit(low)) if w is None else F.when(out < keep_low, low - w * w / (out + w - keep_low)).otherwise(out)
    if high is not None:
        w = None if keep_high is None or keep_high >= high else high - keep_high
        out = F.least(out, F.lit(high)) if w is None else F.when(out > keep_high, high - w * w / (out + w - keep_high)).otherwise(out)
    return F.when(v.isNotNull(), out)


def wrapped(angle: Column, period: float, start: float = 0.0) -> Column:
    """angle brought into [start, start + period)."""
    return F.pmod(angle - start, F.lit(period)) + start


def all_of(text: Column, kind: str) -> Column:
    """1 if a text is not empty and all its characters are of the kind (ASCII), else 0; undefined for undefined."""
    which = {"alnum": "[A-Za-z0-9]+", "alpha": "[A-Za-z]+", "digit": "[0-9]+", "lower": "[a-z]+", "upper": "[A-Z]+", "space": r"\s+"}[kind]
    return text.rlike(f"^{which}$").cast("int")


def part_of(text: Column, start: int, stop: int) -> Column:
    """Characters start to stop, from 1, or from -1 backwards; turned round if stop lies before start; undefined if either
    lies outside."""
    n = F.length(text)
    place = lambda k: F.lit(k) if k > 0 else n + 1 + k
    a, b = place(start), place(stop)
    low, high = F.least(a, b), F.greatest(a, b)
    cut = text.substr(low, high - low + 1)
    return F.when((low >= 1) & (high <= n), F.when(b < a, F.reverse(cut)).otherwise(cut))


def mean_median(values: list[Column]) -> Column:
    """Median of columns that averages the middle pair."""
    s, n = F.array_sort(F.array(*values)), len(values)
    return (s[(n - 1) // 2] + s[n // 2]) / 2


def gardner(vp: Column) -> Column:
    """Density (kg/m3) of P velocity (m/s)."""
    return 310.0 * F.pow(vp, F.lit(0.25))


def mudrock(vp: Column) -> Column:
    """S velocity (m/s) of P velocity by the mudrock line."""
    return (vp - 1360.0) / 1.16


def interpolated(x: Column, table: list[tuple[float, float]]) -> Column:
    """y at x of a small table, linear between its rows and beyond its ends."""
    rows = sorted(table)
    lines = [(x1, y1 + (x - x1) * ((y2 - y1) / (x2 - x1))) for (x1, y1), (x2, y2) in zip(rows, rows[1:])]
    first, rest = lines[0][1], lines[1:]
    # the last line that begins at or before x
    return reduce(lambda out, line: F.when(x >= line[0], line[1]).otherwise(out), rest, first)


def density(x: Column, low: float, step: float, weights: list[float]) -> Column:
    """A sampled density at x: linear between bin centres, 0 beyond them."""
    at = (x - low) / step
    k = F.floor(at).cast("int")
    table = F.array(*[F.lit(float(w)) for w in weights])
    inside = (at >= 0) & (at <= len(weights) - 1)
    this, next_ = F.get(table, k), F.coalesce(F.get(table, k + 1), F.lit(0.0))
    return F.when(inside, this + (at - k) * (next_ - this)).when(x.isNotNull(), 0.0)


def clipped(volume: DataFrame, low: float, high: float, every: dict[str, int]) -> DataFrame:
    """Every n-th cell along the named axes, values brought into [low, high]."""
    keep = reduce(lambda a, b: a & b, [F.col(c) % n == 0 for c, n in every.items()])
    return volume.where(keep).withColumn("val", F.when(F.col("val").isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), F.col("val")))))


def pattern_stack(gathers: DataFrame, reach: int) -> DataFrame:
    """Mean over the cross of positions (inl, crl) up to `reach` away, of the same offset and z. Each trace is sent to the
    2 * 2 * reach + 1 positions that it counts for, and means are summed before the shuffle."""
    moves = [(0, 0), *[(s * k, 0) for k in range(1, reach + 1) for s in (-1, 1)], *[(0, s * k) for k in range(1, reach + 1) for s in (-1, 1)]]
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(c).alias("dc")) for i, c in moves])).alias("m")
    sent = gathers.select("inl", "crl", "offset", "z", "val", to).select((F.col("inl") + F.col("m.di")).alias("inl"), (F.col("crl") + F.col("m.dc")).alias("crl"), "offset", "z", "val")
    return sent.groupBy("inl", "crl", "offset", "z").agg(F.avg("val").alias("stack"), F.count("val").alias("fold")).join(gathers.select("inl", "crl", "offset", "z"), ["inl", "crl", "offset", "z"], "left_semi")


def snapped(horizon: DataFrame, events: DataFrame, reach: int) -> DataFrame:
    """The event (pos, ez) nearest to each horizon node (pos, z) within `reach`, the upper one on a tie; else undefined.
    Events are looked up by equality of position and whole distance, at most 2 * reach + 1 of them a node."""
    near = horizon.select("pos", "z", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d")).withColumn("ez", F.col("z") + F.col("d"))
    hit = near.join(events.select("pos", "ez").distinct(), ["pos", "ez"]).groupBy("pos", "z").agg(F.min_by("ez", F.struct(F.abs("d"), "ez")).alias("event"))
    return horizon.select("pos", "z").join(hit, ["pos", "z"], "left")


def gaps(traces: DataFrame) -> DataFrame:
    """What a scan of a store reports for each line (inl): extent, traces, missing positions inside it, repeated ones."""
    each = traces.groupBy("inl", "crl").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("crl").over(Window.partitionBy("inl").orderBy("crl"))
    each = each.withColumn("missing", F.coalesce(F.col("crl") - before - 1, F.lit(0)))
    return each.groupBy("inl").agg(F.min("crl").alias("first"), F.max("crl").alias("last"), F.sum("n").alias("traces"), F.sum("missing").alias("missing"), F.sum(F.col("n") - 1).alias("repeats"))
