"""Contour lines of grids: segments cell by cell, chains block by block, and chains put in order by doubling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import written

#: Cells along the side of a block, whose chains one task makes.
BLOCK = 128


def segments(value: np.ndarray, level: float) -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """Directed segments (edge, edge) through cells, with what is at or above the level on one side always. An edge is (i, j,
    0) to the right of node (i, j), or (i, j, 1) below it. Cells with an undefined corner have none; of a saddle the mean
    of the corners says which two lie together."""
    out = []
    above = value >= level
    sound = np.isfinite(value)
    whole = sound[:-1, :-1] & sound[:-1, 1:] & sound[1:, :-1] & sound[1:, 1:]
    count = above[:-1, :-1].astype(int) + above[:-1, 1:] + above[1:, :-1] + above[1:, 1:]
    for i, j in np.argwhere(whole & (count > 0) & (count < 4)).tolist():
        corners = [above[i, j], above[i, j + 1], above[i + 1, j + 1], above[i + 1, j]]
        edges = [(i, j, 0), (i, j + 1, 1), (i + 1, j, 0), (i, j, 1)]
        down = [k for k in range(4) if corners[k] and not corners[(k + 1) % 4]]
        up = [k for k in range(4) if not corners[k] and corners[(k + 1) % 4]]
        together = len(down) == 2 and value[i : i + 2, j : j + 2].mean() >= level
        for u in up:
            # the crossing before this one, around the corner that is cut off, or the one behind it
            d = min(down, key=lambda k: (u - k) % 4 if together else (k - u) % 4)
            out.append((edges[u], edges[d]))
    return out


def _key(edge: tuple[int, int, int]) -> int:
    return (edge[0] << 32) + (edge[1] << 1) + edge[2]


def chains(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Directed segments joined: open chains first, from their starts; rings begin and end at their least edge."""
    after, before = dict(pairs), {b: a for a, b in pairs}
    out, seen = [], set()
    for start in [*sorted(a for a in after if a not in before), *sorted(after)]:
        if start in seen:
            continue
        chain = [start]
        seen.add(start)
        while (step := after.get(chain[-1])) is not None:
            chain.append(step)
            if step in seen:
                break
            seen.add(step)
        out.append(chain)
    return out


def contour_lines(grid: DataFrame, level: float, block: int = BLOCK) -> DataFrame:
    """line, closed, seq (from 0), inl, crl of the points of the lines where a grid (inl, crl: whole numbers of 0 to 2^31;
    val) crosses the level.

    Points lie on the edges between neighbouring nodes, linear between their values; each crossing is in one line, and a
    closed line ends with the point it begins with. `line` is the least crossing of the line. Nodes that are missing, null
    or without a position have no lines beside them; of repeated nodes the mean counts; an empty grid gives no rows.

    Blocks of cells make chains of their own. A chain goes on where the chain begins whose first crossing is its last: how
    many points lie before each is found by doubling over chains, not points, in as many rounds as the logarithm of the
    most chains a line has. Rings are opened at their least chain first.
    """
    rows = grid.select(F.col("inl").cast("long").alias("inl"), F.col("crl").cast("long").alias("crl"), F.col("val").cast("double").alias("val")).where("inl IS NOT NULL AND crl IS NOT NULL AND val IS NOT NULL AND NOT isnan(val)")
    rows = rows.groupBy("inl", "crl").agg(F.avg("val").alias("val"))
    near = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / block), F.floor((F.col(c) - 1) / block)))
    dealt = rows.select("*", F.explode(near("inl")).alias("bi")).select("*", F.explode(near("crl")).alias("bj")).where("bi >= 0 AND bj >= 0")

    def one(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py() * block, table["bj"][0].as_py() * block
        value = np.full((block + 1, block + 1), np.nan)
        value[table["inl"].to_numpy() - bi, table["crl"].to_numpy() - bj] = table["val"].to_numpy()
        made = chains([(_key((a[0] + bi, a[1] + bj, a[2])), _key((b[0] + bi, b[1] + bj, b[2]))) for a, b in segments(value, level)])
        points = []
        for chain in made:
            keys = np.array(chain, np.int64)
            i, j, down = (keys >> 32), (keys & 0xFFFFFFFF) >> 1, keys & 1
            v = value[i - bi, j - bj]
            w = value[i - bi + down, j - bj + 1 - down]
            part = (level - v) / (w - v)
            points.append([{"inl": x, "crl": y} for x, y in zip((i + part * down).tolist(), (j + part * (1 - down)).tolist())])
        firsts, lasts, leasts = ([f(c) for c in made] for f in (lambda c: c[0], lambda c: c[-1], min))
        return pa.Table.from_arrays([pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(leasts, pa.int64()), pa.array(points, _POINTS)], names=["first", "last", "least", "points"])

    found = written(dealt.groupBy("bi", "bj").applyInArrow(one, "first long, last long, least long, points array<struct<inl:double,crl:double>>"))
    steps = F.size("points").cast("long") - 1
    # what a chain sees ahead: the chain where it looks on from (null: none), points up to there, least crossing, chains passed
    ahead = written(found.select(F.col("first").alias("chain"), F.when(F.col("first") != F.col("last"), F.col("last")).alias("next"), steps.alias("points"), "least", F.col("first").alias("least_chain"), (F.col("first") == F.col("last")).alias("ring")))
    ahead = written(ahead.join(ahead.select(F.col("chain").alias("next"), F.lit(1).alias("known")), "next", "left").withColumn("next", F.when(F.col("known") == 1, F.col("next"))).drop("known"))
    looked = _doubled(ahead)
    # who still looks on after so many steps goes round: such a ring is opened before its chain of least first crossing
    rings = looked.where("next IS NOT NULL").select("chain", "least_chain")
    opened = ahead.join(rings.withColumnRenamed("least_chain", "opens"), "chain", "left").withColumn("ring", F.col("ring") | F.col("opens").isNotNull())
    opened = written(opened.withColumn("next", F.when(F.col("opens").isNull() | (F.col("next") != F.col("opens")), F.col("next"))).drop("opens"))
    ranked = _doubled(opened).select("chain", F.col("points").alias("left"), "end", "ring")
    total = ranked.groupBy("end").agg(F.max("left").alias("all"))
    lines = looked.select("chain", F.col("least").alias("from_here"))
    least = ranked.join(lines, "chain").groupBy("end").agg(F.min("from_here").alias("line"))
    placed = ranked.join(total, "end").join(least, "end").select("chain", "line", F.col("ring").alias("closed"), (F.col("all") - F.col("left")).alias("before"), (F.col("all") - F.col("left") + 0 == 0).alias("head"))
    points = found.join(placed, F.col("first") == F.col("chain")).select("line", "closed", "before", "head", F.posexplode("points").alias("k", "p"))
    # the last point of a chain is the first of the next
    return points.where("k > 0 OR head").select("line", "closed", (F.col("before") + F.col("k")).alias("seq"), "p.inl", "p.crl")


_POINTS = pa.list_(pa.struct([("inl", pa.float64()), ("crl", pa.float64())]))


def _doubled(ahead: DataFrame) -> DataFrame:
    """ahead with all that lies ahead of each chain: points up to the end, the last chain (end), the least crossing and first
    crossing passed; next stays where there is no end after as many steps as there are chains."""
    n, passed = ahead.count(), 1
    ahead = ahead.withColumn("end", F.col("chain"))
    while passed < n:
        on = ahead.select(F.col("chain").alias("next"), F.col("next").alias("further"), F.col("points").alias("more"), F.col("least").alias("least_on"), F.col("least_chain").alias("chain_on"), F.col("end").alias("end_on"))
        both = ahead.join(on, "next", "left")
        ahead = written(both.select("chain", F.col("further").alias("next"), (F.col("points") + F.coalesce("more", F.lit(0))).alias("points"), F.least("least", "least_on").alias("least"), F.least("least_chain", "chain_on").alias("least_chain"), "ring", F.coalesce("end_on", "end").alias("end")))
        if ahead.where("next IS NOT NULL").isEmpty():
            break
        passed *= 2
    return ahead
