"""Positions and point tables: providers, filters, columns, conditions, alignment of inputs, and layers in gates."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.sources.tables import written

# ---- providers


def box(spark: SparkSession, **ranges: tuple[int, int, int]) -> DataFrame:
    """All positions of a regular sub-volume: (first, last, step) for each dimension, ends included."""
    (name, (first, last, step)), *others = ranges.items()
    out = spark.range(first, last + 1, step).withColumnRenamed("id", name)
    for other, (a, b, s) in others:
        out = out.withColumn(other, F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(s).cast("long"))))
    return out


def along_lines(lines: DataFrame, first: Column, last: Column, step: int, name: str = "trc") -> DataFrame:
    """The positions first, first + step, ... last of each line; none where last is before first."""
    return lines.where(last >= first).withColumn(name, F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))))


def between_surfaces(top: DataFrame, base: DataFrame, keys: list[str], step: float) -> DataFrame:
    """keys and z: from the upper to the lower of two surfaces (keys, z) in steps, where both are defined."""
    both = top.join(base.withColumnRenamed("z", "other"), keys).where("z IS NOT NULL AND other IS NOT NULL")
    low, high = F.least("z", "other"), F.greatest("z", "other")
    steps = F.sequence(F.lit(0), F.floor((high - low) / step).cast("int"))
    return both.select(*keys, low.alias("low"), F.explode(steps).alias("k")).select(*keys, (F.col("low") + F.col("k") * step).alias("z"))


def around(points: DataFrame, inl: int, crl: int) -> DataFrame:
    """Distinct positions within a stepout of the points (inl, crl)."""
    shift = lambda c, n: F.explode(F.sequence(F.col(c) - n, F.col(c) + n))
    return points.select(shift("inl", inl).alias("inl"), "crl").select("inl", shift("crl", crl).alias("crl")).distinct()


def kept(positions: DataFrame, given: DataFrame, keys: list[str], accept: bool = True) -> DataFrame:
    """Positions that are among the given ones, or, not accepting, those that are not."""
    return positions.join(given.select(*keys).distinct(), keys, "left_semi" if accept else "left_anti")


# ---- filters and conditions


def fraction(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) that looks random and is the same for the same key and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def passes(key: Column, ratio: float) -> Column:
    """Whether a position passes a random filter; a ratio over 1 is per cent."""
    return fraction(key) < (ratio / 100 if ratio > 1 else ratio)


def all_pass(tests: list[Column], any_of: bool = False) -> Column:
    return reduce(operator.or_ if any_of else operator.and_, tests)


#: Comparisons of a condition, by their sign.
COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def condition(column: str, sign: str, value=None) -> Column:
    """column sign value; "is null" and "is not null" take no value; "like" with % and _."""
    c = F.col(column)
    if sign.lower() == "is null":
        return c.isNull()
    if sign.lower() == "is not null":
        return c.isNotNull()
    return c.like(value) if sign.lower() == "like" else COMPARISONS[sign](c, F.lit(value))


def every_nth(positions: DataFrame, line: str, order: str, n: int) -> DataFrame:
    """Every nth position of each line."""
    place = F.row_number().over(Window.partitionBy(line).orderBy(order))
    return positions.withColumn("place", place).where((F.col("place") - 1) % n == 0).drop("place")


def changed(table: DataFrame, key: str, values: dict[str, Column], where: Column) -> DataFrame:
    """UPDATE: the columns get values where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


# ---- facts about owners


def held_by_all(facts: DataFrame, owner: str, name: str) -> DataFrame:
    """The names that every owner has."""
    owners = facts.agg(F.count_distinct(owner).alias("owners"))
    return facts.groupBy(name).agg(F.count_distinct(owner).alias("n")).join(F.broadcast(owners)).where("n = owners").select(name)  # one row


def presence(facts: DataFrame, owner: str, name: str, names: list[str], where: Column) -> DataFrame:
    """owner and a column for each name: 1 if a row of both meets the condition, else 0."""
    return facts.groupBy(owner).agg(*[F.max(F.when(where & (F.col(name) == n), 1).otherwise(0)).alias(n.lower()) for n in names])


def ordering(positions: DataFrame, line: str, place: str, order: list[str]) -> DataFrame:
    """line, n, repeats, rises and falls: how the places of a line follow each other."""
    step = F.col(place) - F.lag(place).over(Window.partitionBy(line).orderBy(*order))
    count = lambda c: F.count(F.when(c, 1))
    s = F.col("step")
    return positions.withColumn("step", step).groupBy(line).agg(F.count(F.lit(1)).alias("n"), count(s == 0).alias("repeats"), count(s > 0).alias("rises"), count(s < 0).alias("falls"))


def closed(pairs: DataFrame) -> DataFrame:
    """above, below: all that follows from pairs by going on. Each round doubles the reach, and joins only what the round
    before has found to the rest; names that are null follow nothing."""
    out = fresh = written(pairs.select("above", "below").where("above IS NOT NULL AND below IS NOT NULL").distinct())
    while not fresh.isEmpty():
        on = lambda a, b: a.select("above", F.col("below").alias("mid")).join(b.select(F.col("above").alias("mid"), "below"), "mid").select("above", "below")
        fresh = written(on(out, fresh).union(on(fresh, out)).distinct().join(out, ["above", "below"], "left_anti"))
        out = out.union(fresh)
    return out


# ---- running sums, gates and layers


def running_total(rows: DataFrame, key: str, z: str, value: str, block: int = 1024) -> DataFrame:
    """rows with total: the sum of value up to z along key, undefined values skipped; undefined before the first one.

    Blocks of z are summed first, then their sums, so that no task orders a whole trace."""
    cut = rows.withColumn("block", F.floor(F.col(z) / block))
    sums = cut.groupBy(key, "block").agg(F.sum(value).alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("s")
    inside = F.sum(value).over(Window.partitionBy(key, "block").orderBy(z).rowsBetween(Window.unboundedPreceding, 0))
    both = cut.withColumn("inside", inside).join(before, [key, "block"])
    total = F.when(F.col("inside").isNotNull() | F.col("before").isNotNull(), F.coalesce("inside", F.lit(0.0)) + F.coalesce("before", F.lit(0.0)))
    return both.withColumn("total", total).drop("block", "inside", "before")


def in_gate(top: Column, base: Column, first: Column, last: Column) -> Column:
    """Thickness of a layer that lies in the gate."""
    return F.greatest(F.lit(0.0), F.least(base, last) - F.greatest(top, first))


def layer_mean(value: Column, thickness: Column, slowness: bool = False) -> Column:
    """Mean of layers weighted by thickness; velocities as slowness. Layers thinner than 1e-5 or undefined are skipped."""
    use = value.isNotNull() & (thickness >= 1e-5)
    w = F.sum(F.when(use, thickness))
    return w / F.sum(F.when(use, thickness / value)) if slowness else F.sum(F.when(use, thickness * value)) / w


def transformed(kind: str, value: Column, by: float) -> Column:
    """pow: value ** by; log: logarithm to the base; exp: base ** value."""
    return {"pow": F.pow(value, F.lit(by)), "log": F.try_divide(F.ln(value), F.ln(F.lit(by))), "exp": F.pow(F.lit(by), value)}[kind]


def gained(z: Column, gates: list[float], factors: list[float]) -> Column:
    """The gain at z: from factor to factor across each gate, 1 outside."""
    out = F.lit(1.0)
    for a, b, f, g in reversed(list(zip(gates, gates[1:], factors, factors[1:], strict=False))):
        out = F.when((z >= a) & (z <= b), f + (z - a) / (b - a) * (g - f)).otherwise(out)
    return out


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """median: the element n / 2 of a key's n values in order, which weights do not move; balance: the least value up to which
    half the weight lies. Null values and weights that are null or not above 0 are left out; values that repeat are one
    row before a key's rows are ordered."""
    each = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(key, value).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(value)
    whole = each.groupBy(key).agg((F.sum("w") / 2).alias("half"), F.floor(F.sum("n") / 2).alias("middle"))
    ranked = each.withColumn("up_to", F.sum("w").over(order)).withColumn("before", F.sum("n").over(order)).join(whole, key)
    return ranked.groupBy(key).agg(F.min(F.when(F.col("before") > F.col("middle"), F.col(value))).alias("median"), F.min(F.when(F.col("up_to") >= F.col("half"), F.col(value))).alias("balance"))


def find_exact(points: DataFrame, table: DataFrame, keys: list[str], z: str, found: str, tolerance: float = 1e-6) -> DataFrame:
    """points with `found`: the least of table's rows at the same keys whose z differs by less than tolerance, or null. Null
    keys or z find nothing.

    Rows meet by cells of twice the tolerance: a point looks in its own and those beside it."""
    cell = F.floor(F.col(z) / (2 * tolerance))
    held = table.select(*keys, F.col(z).alias("held z"), cell.alias("cell"), F.col(found).alias("held id"))
    asked = points.withColumn("point", F.monotonically_increasing_id())
    asked = written(asked)
    near = asked.select("point", *keys, F.col(z).alias("z"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).join(held, [*keys, "cell"])
    best = near.where(F.abs(F.col("z") - F.col("held z")) < tolerance).groupBy("point").agg(F.min("held id").alias(found))
    return asked.join(best, "point", "left").drop("point")


# ---- volumes


def aligned(volumes: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Several volumes at the positions that all of them have, a column for each."""
    return reduce(lambda a, b: a.join(b, keys), [v.select(*keys, F.col(value).alias(n)) for n, v in volumes.items()])


#: Tasks' shares of a cell's points in within().
_SHARES = 4


def within(points: DataFrame, x: str, intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Each point beside each interval that holds it.

    Both meet in cells: of a width for the longest intervals, halved for shorter ones until an interval spans eight or so;
    so most of what meets is wanted. Tasks are as many as shuffles have, however few bytes they read: what they give may be
    the square of that; and a cell's points are dealt out to several.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = F.greatest(F.col(high) - F.col(low), F.lit(width / (1 << 20)))
    level = F.least(F.greatest(F.ceil(F.log2(8 * width / length)), F.lit(0)), F.lit(20)).cast("int")
    size = F.lit(width) / F.pow(F.lit(2.0), F.col("level"))
    held = intervals.where(F.col(high) >= F.col(low)).withColumn("level", level)
    levels = [row.level for row in held.select("level").distinct().collect()]  # 21 at most
    right = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
    left = points.where(F.col(x).isNotNull()).withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")))
    left = left.withColumns({"cell": F.floor(F.col(x) / size), "share": F.pmod(F.xxhash64(*points.columns), F.lit(_SHARES)).cast("int")})
    keys = ["level", "cell", "share"]
    return left.repartition(n, *keys).join(right.repartition(n, *keys), keys).where(F.col(x).between(F.col(low), F.col(high))).drop(*keys)


def polyline(spark: SparkSession, nodes: list[tuple[float, float]], step: float) -> DataFrame:
    """trc, inl, crl: bins along a line through the nodes, one at each step of distance."""
    legs = []
    for (x1, y1), (x2, y2) in zip(nodes, nodes[1:]):
        n = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        legs.append((sum(leg[5] for leg in legs), x1, y1, (x2 - x1) / n, (y2 - y1) / n, n))
    length = sum(leg[5] for leg in legs)
    d = F.col("id") * step
    at = lambda k: reduce(lambda rest, leg: F.when(d >= leg[0], leg[k] + (d - leg[0]) * leg[k + 2]).otherwise(rest), legs[1:], legs[0][k] + d * legs[0][k + 2])
    return spark.range(int(length / step) + 1).select(F.col("id").alias("trc"), F.round(at(1)).cast("long").alias("inl"), F.round(at(2)).cast("long").alias("crl"))


def without_null_traces(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The traces that have a value other than 0."""
    sound = rows.groupBy(key).agg(F.max(F.abs(F.coalesce(value, F.lit(0.0)))).alias("most")).where("most > 0").select(key)
    return rows.join(sound, key, "left_semi")


def untangled(top: DataFrame, base: DataFrame, keys: list[str], remove: bool) -> DataFrame:
    """The base surface (keys, z) where it lies above the top: moved to it, or removed."""
    both = base.join(top.withColumnRenamed("z", "zt"), keys, "left")
    bad = (F.col("z") < F.col("zt")) & F.col("z").isNotNull() & F.col("zt").isNotNull()
    return both.where(~F.coalesce(bad, F.lit(False))).select(*keys, "z") if remove else both.select(*keys, F.when(bad, F.col("zt")).otherwise(F.col("z")).alias("z"))


def captures(text: Column, pattern: str, n: int) -> Column:
    """What the nth * of a pattern stands for (from the end, if negative); "" where the text does not match."""
    parts = pattern.split("*")
    escaped = [("".join(f"\\{c}" if not c.isalnum() else c for c in p)) for p in parts]
    return F.regexp_extract(text, "(?s)^" + "(.*)".join(escaped) + "$", n if n > 0 else len(parts) + n)
