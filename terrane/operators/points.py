"""Point tables: selection, lookup, merging and ordering by position."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import triangles
from terrane.sources.tables import written


def in_range(column: str, start: int, stop: int, step: int = 1) -> Column:
    c = F.col(column)
    return c.between(start, stop) & ((c - start) % step == 0)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: an odd number of edges to the right of it, as one expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def glob(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether text matches a pattern of *, ? and [...] as a whole."""
    parts = re.split(r"(\*|\?|\[[^\]]*\])", pattern)
    regex = "".join({"*": ".*", "?": "."}.get(p, p if p.startswith("[") else re.sub(r"([^\w\s])", r"\\\1", p)) for p in parts)
    return column.rlike(f"{'(?is)' if ignore_case else '(?s)'}^{regex}$")


def matches(patterns: dict[str, str], any_of: bool = False, negate: bool = False) -> Column:
    tests = [glob(F.col(c), p) for c, p in patterns.items()]
    both = functools.reduce(lambda a, b: a | b if any_of else a & b, tests)
    return ~both if negate else both


def subselect(points: DataFrame, columns: list[str], ranges: dict[str, tuple[float | None, float | None]], most: int | None = None, key: str | None = None) -> DataFrame:
    """Columns of the rows that are defined in all of them and lie in the ranges (open ends: None); with `most`, so many of
    them, in the order of a hash of key: the same rows each time, and a row's place says nothing about it."""
    out = points
    for c, (low, high) in ranges.items():
        out = out.where((F.col(c) >= low) if low is not None else F.lit(True)).where((F.col(c) <= high) if high is not None else F.lit(True))
    out = out.dropna(subset=columns)
    return out.orderBy(F.md5(F.col(key).cast("string")), key).limit(most).select(*columns) if most else out.select(*columns)


#: Different places of a tile, about, and points that meet them in a task at a time.
_TILE, _PART = 512, 50_000


def nearest(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """The nearest of others (oid, ox, oy) within radius of each point (id, x, y), ties to the smaller oid; places that are
    null or not finite are near nothing.

    Others at one place are one, the smallest; their places are cut into tiles of about as many each. A point first meets
    those of its own tile, then those of the tiles that may hold a nearer one. So a point meets a few tiles' worth, however
    many lie within the radius, and a task holds one tile and a part of the points that meet it.
    """
    finite = lambda *cs: functools.reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < math.inf for c in cs])
    number = lambda c: F.col(c).cast("double") + 0.0
    places = written(others.where(finite("ox", "oy")).groupBy(number("ox").alias("x"), number("oy").alias("y")).agg(F.min("oid").alias("oid")))
    tiles = triangles.layout(places, _TILE) or triangles.Layout([], [[]], (0.0, 0.0), (0.0, 0.0), 1)
    places = written(triangles.tiled(places, tiles))
    boxes = {b.tile: (b.x0, b.x1, b.y0, b.y1) for b in places.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()}
    kind = points.schema["id"].dataType.simpleString()
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = triangles.tiled(points.where(finite("x", "y")).select(number("x").alias("x"), number("y").alias("y"), "id").repartition(n), tiles)
    first = written(_met(written(own), places, radius))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles but a point's own that may hold a nearer place."""
        for batch in batches:
            rows, found = [], []
            for k, (x, y, tile, best) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "tile", "d2")))):
                most = radius * radius if best is None else best
                reach = math.sqrt(most) * (1 + 1e-9)
                near = [q for q in tiles.touched(x - reach, x + reach, y - reach, y + reach) if q != tile and q in boxes]
                if not near:
                    continue
                x0, x1, y0, y1 = np.array([boxes[q] for q in near]).T
                most = min(most, (np.maximum(x - x0, x1 - x) ** 2 + np.maximum(y - y0, y1 - y) ** 2).min())
                least = np.maximum(np.maximum(x0 - x, x - x1), 0.0) ** 2 + np.maximum(np.maximum(y0 - y, y - y1), 0.0) ** 2
                hit = [q for q, d in zip(near, least.tolist()) if d <= most * (1 + 1e-9)]
                rows += [k] * len(hit)
                found += hit
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in ("id", "x", "y")), pa.array(found, pa.int64())], names=["id", "x", "y", "tile"])

    second = _met(written(first.repartition(n).mapInArrow(further, f"id {kind}, x double, y double, tile long")), places, radius)
    near = first.unionByName(second).where("d2 IS NOT NULL")
    return near.groupBy("id").agg(F.min(F.struct("d2", "oid")).alias("best")).select("id", "best.oid", F.sqrt("best.d2").alias("distance"))


def _met(asked: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """asked (id, x, y, tile) with d2 and oid of the nearest of their tile's places within radius, or nulls."""
    sizes = F.broadcast(asked.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / _PART).cast("long").alias("parts")))  # a row for each tile
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = asked.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64("id", "x", "y"), F.col("parts"))).drop("parts")
    right = places.join(sizes, "tile").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    kinds = {"id": asked.schema["id"].dataType.simpleString(), "oid": places.schema["oid"].dataType.simpleString()}

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.take(pa.compute.sort_indices(theirs, [("oid", "ascending")]))
        x, y, ox, oy = (t[c].to_numpy() for t, c in ((mine, "x"), (mine, "y"), (theirs, "x"), (theirs, "y")))
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        step = max(1, (1 << 18) // max(len(ox), 1))
        for k in range(0, len(x) if len(ox) else 0, step):
            dx, dy = x[k : k + step, None] - ox, y[k : k + step, None] - oy
            d2 = dx * dx + dy * dy
            at[k : k + step] = d2.argmin(1)  # the first of equals has the smallest oid
            best[k : k + step] = d2[np.arange(len(d2)), at[k : k + step]]
        lost = ~(best <= radius * radius)
        oid = theirs["oid"].take(pa.array(at, mask=lost))
        return pa.Table.from_arrays([mine["id"], mine["x"], mine["y"], mine["tile"], pa.chunked_array([pa.array(best, mask=lost)]), oid], names=["id", "x", "y", "tile", "d2", "oid"])

    pairs = left.repartition(n, "tile", "part").groupBy("tile", "part").cogroup(right.repartition(n, "tile", "part").groupBy("tile", "part"))
    return pairs.applyInArrow(run, f"id {kinds['id']}, x double, y double, tile long, d2 double, oid {kinds['oid']}")


def merge(left: DataFrame, right: DataFrame, keys: list[str], value: str, policy: str) -> DataFrame:
    """All positions of both tables. policy: `keep` the left value where the left has the position, `fill` it where it is
    undefined, `overwrite` it where the right has the position."""
    l, r = left.select(*keys, F.col(value).alias("lv"), F.lit(True).alias("in_l")), right.select(*keys, F.col(value).alias("rv"), F.lit(True).alias("in_r"))
    chosen = {"keep": F.when(F.col("in_l"), F.col("lv")).otherwise(F.col("rv")), "fill": F.coalesce("lv", "rv"), "overwrite": F.when(F.col("in_r"), F.col("rv")).otherwise(F.col("lv"))}[policy]
    return l.join(r, keys, "full").select(*keys, chosen.alias(value))


def first_of(volumes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Each position from the first of the volumes that has it."""
    ranked = [v.withColumn("rank", F.lit(i)) for i, v in enumerate(volumes)]
    rest = [c for c in volumes[0].columns if c not in keys]
    best = functools.reduce(DataFrame.unionByName, ranked).groupBy(*keys).agg(F.min(F.struct("rank", *rest)).alias("b"))
    return best.select(*keys, *[f"b.{c}" for c in rest])


def new_keys(rows: DataFrame, keys: list[str], order: list[str], within: list[str]) -> DataFrame:
    """Rows whose keys differ from those of the row before."""
    w = Window.partitionBy(*within).orderBy(*order)
    same = functools.reduce(lambda a, b: a & b, [F.lag(k).over(w).eqNullSafe(F.col(k)) for k in keys])
    return rows.withColumn("same", same & (F.row_number().over(w) > 1)).where("NOT same").drop("same")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those of the same key, and the new ones."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def holds_all(facts: DataFrame, owner: str, name: str, names: list[str]) -> DataFrame:
    """Owners that have every one of the names; none if the list is empty."""
    found = facts.where(F.col(name).isin(names)).groupBy(owner).agg(F.count_distinct(name).alias("n"))
    return found.where((F.col("n") == len(set(names))) & F.lit(bool(names))).select(owner)
