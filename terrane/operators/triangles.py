"""Delaunay triangles of scattered points, tile by tile until every circumcircle is proven empty, and gridding in them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.tables import parts_for, written

#: Points of a tile, about; a task holds a few tiles' worth.
TILE = 2048
#: Points beyond a tile that it starts with lie within this many mean distances of points.
HALO = 4.0
_CORNERS = ["ax", "ay", "bx", "by", "cx", "cy"]
_GHOST = -1


def orient(a, b, c) -> int:
    """1, 0, -1: c lies left of, on, right of the line from a to b; exact."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) <= 4e-16 * (abs(left) + abs(right)):
        (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p) for p in (a, b, c))
        det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (det > 0) - (det < 0)


def in_circle(a, b, c, d) -> bool:
    """Whether d lies within the circle through a, b, c, which turn left; exact. Of four points on one circle, the least
    (by x, then y) counts as lifted a little: so that each set of points has one triangulation, wherever it is made."""
    x, y = d
    x0, y0, x1, y1, x2, y2 = a[0] - x, a[1] - y, b[0] - x, b[1] - y, c[0] - x, c[1] - y
    p0, q0, p1, q1, p2, q2 = x1 * y2, y1 * x2, x2 * y0, y2 * x0, x0 * y1, y0 * x1
    z0, z1, z2 = x0 * x0 + y0 * y0, x1 * x1 + y1 * y1, x2 * x2 + y2 * y2
    det = z0 * (p0 - q0) + z1 * (p1 - q1) + z2 * (p2 - q2)
    if abs(det) > 2e-15 * (z0 * (abs(p0) + abs(q0)) + z1 * (abs(p1) + abs(q1)) + z2 * (abs(p2) + abs(q2))):
        return det > 0
    exact = [tuple(map(Fraction, p)) for p in (a, b, c, d)]
    rows = [(x - exact[3][0], y - exact[3][1]) for x, y in exact[:3]]
    (x0, y0), (x1, y1), (x2, y2) = rows
    det = (x0 * x0 + y0 * y0) * (x1 * y2 - y1 * x2) + (x1 * x1 + y1 * y1) * (x2 * y0 - y2 * x0) + (x2 * x2 + y2 * y2) * (x0 * y1 - y0 * x1)
    if det:
        return det > 0
    lifted = min((tuple(p), k) for k, p in enumerate((a, b, c, d)))[1]
    return (orient(b, c, d), -orient(a, c, d), orient(a, b, d), -orient(a, b, c))[lifted] > 0


def _beyond(a, b, p) -> bool:
    """Whether p lies outside the hull edge from b to a (seen from a to b: left of it), or on it between both."""
    side = orient(a, b, p)
    return side > 0 or (side == 0 and min(a, b) < p < max(a, b))


def triangulate(points: list[tuple[float, float]]) -> dict[tuple[int, int], int]:
    """The Delaunay triangulation of distinct points: for each directed edge the third corner of the triangle on its left,
    _GHOST beyond the hull; empty if no three points make a triangle.

    Points go in one by one, along strips: the triangles whose circle holds a new point make room for a fan around it.
    """
    n = len(points)
    third = next((k for k in range(2, n) if orient(points[0], points[1], points[k])), None)
    if third is None:
        return {}
    a, b, c = (0, 1, third) if orient(points[0], points[1], points[third]) > 0 else (1, 0, third)
    left: dict[tuple[int, int], int] = {}

    def add(i: int, j: int, k: int) -> None:
        left[i, j], left[j, k], left[k, i] = k, i, j

    add(a, b, c)
    for i, j in ((a, b), (b, c), (c, a)):
        add(j, i, _GHOST)

    def holds(i: int, j: int, k: int, p) -> bool:
        while _GHOST in (i, j) and k != _GHOST:
            i, j, k = j, k, i
        return _beyond(points[i], points[j], p) if k == _GHOST else in_circle(points[i], points[j], points[k], p)

    xs, ys = np.array(points).T
    strip = np.floor((xs - xs.min()) / max((xs.max() - xs.min()) / max(1, math.isqrt(n) // 2), 1e-300))
    order = np.lexsort((np.where(strip % 2 == 0, ys, -ys), strip))
    edge = (a, b)
    for m in order.tolist():
        if m in (0, 1, third):
            continue
        p, (i, j) = points[m], edge
        if orient(points[i], points[j], p) < 0:
            i, j = j, i
        while (k := left[i, j]) != _GHOST:  # p is not right of the edge from i to j
            if orient(points[j], points[k], p) < 0:
                i, j = k, j
            elif orient(points[k], points[i], p) < 0:
                i, j = i, k
            else:
                break
        gone, todo, rim = {(i, j, k)}, [(i, j, k)], []
        while todo:
            i, j, k = todo.pop()
            for u, v in ((i, j), (j, k), (k, i)):
                w = left[v, u]
                if (v, u, w) in gone or (u, w, v) in gone or (w, v, u) in gone:
                    continue
                if holds(v, u, w, p):
                    gone.add((v, u, w))
                    todo.append((v, u, w))
                else:
                    rim.append((u, v))
        for i, j, k in gone:
            for e in ((i, j), (j, k), (k, i)):
                left.pop(e, None)
        for u, v in rim:
            add(u, v, m)
        edge = next((m, u) for u, v in rim if _GHOST not in (u, v))
    return left


def circle(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of the circles through the corners (rows of six numbers)."""
    ax, ay, bx, by, cx, cy = t.T
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, np.hypot(ux, uy)


class Layout:
    """Tiles of about as many points each: strips of x, cut by y."""

    def __init__(self, xs: list[float], ys: list[list[float]], low: tuple[float, float], high: tuple[float, float], n: int):
        self.xs, self.ys = np.array(sorted(set(xs))), [np.array(sorted(set(y))) for y in ys]
        self.low, self.high = low, high
        self.first = np.cumsum([0, *(len(y) + 1 for y in self.ys)])
        edges = [low[0], *self.xs.tolist(), high[0]]
        self.width = np.diff(edges)
        self.gap = math.sqrt(max((high[0] - low[0]) * (high[1] - low[1]), 0.0) / max(n, 1))

    def tile(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.xs, x, "right")
        out = np.zeros(len(x), np.int64)
        for s in np.unique(strip).tolist():
            own = strip == s
            out[own] = self.first[s] + np.searchsorted(self.ys[s], y[own], "right")
        return out

    def parts(self, spark: SparkSession) -> int:
        """Tasks for work on all tiles: a fixed number, as a tile's work is far more than its bytes, by which Spark would put tasks together."""
        return int(min(self.first[-1], parts_for(spark, int(self.first[-1]) * TILE)))

    def box(self, tile: int) -> tuple[float, float, float, float]:
        s = int(np.searchsorted(self.first, tile, "right")) - 1
        x, y, k = [-math.inf, *self.xs, math.inf], [-math.inf, *self.ys[s], math.inf], tile - int(self.first[s])
        return x[s], x[s + 1], y[k], y[k + 1]

    def touched(self, x0: float, x1: float, y0: float, y1: float) -> list[int]:
        out = []
        for s in range(int(np.searchsorted(self.xs, x0, "right")), int(np.searchsorted(self.xs, x1, "right")) + 1):
            k0, k1 = np.searchsorted(self.ys[s], [y0, y1], "right").tolist()
            out += range(int(self.first[s]) + k0, int(self.first[s]) + k1 + 1)
        return out


def layout(points: DataFrame, tile: int = TILE) -> Layout | None:
    """Tiles for points (x, y), about as wide as high where most points lie; what the driver gets is one number for each tile."""
    most = [F.percentile_approx(c, [0.05, 0.95]).alias(f"{c}s") for c in "xy"]
    n, x0, x1, y0, y1, xs, ys = points.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y"), *most).first()
    if n < 3:
        return None
    wide, high = xs[1] - xs[0], ys[1] - ys[0]
    need = math.ceil(n / tile)
    strips = max(1, min(need, round(math.sqrt(need * wide / high)))) if wide > 0 and 0 < high < math.inf and wide < math.inf else math.ceil(math.sqrt(need))
    pieces = -(-need // strips)
    x_cuts, y_cuts = ([k / m for k in range(1, m)] for m in (strips, pieces))
    xs = sorted(set(points.agg(F.percentile_approx("x", x_cuts, 100 * strips)).first()[0])) if x_cuts else []
    one = Layout(xs, [[] for _ in range(len(xs) + 1)], (x0, y0), (x1, y1), n)
    if not y_cuts:
        return one
    rows = tiled(points, one).groupBy("tile").agg(F.percentile_approx("y", y_cuts, 100 * pieces).alias("cuts")).collect()
    ys = {r.tile: r.cuts for r in rows}
    return Layout(xs, [ys.get(s, []) for s in range(len(xs) + 1)], (x0, y0), (x1, y1), n)


def tiled(points: DataFrame, tiles: Layout, halo: bool = False) -> DataFrame:
    """points (x, y) with their tile; with halo instead with other tiles that they lie near."""
    others = [c for c in points.columns if c not in ("x", "y")]
    schema = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("tile", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = tiles.tile(x, y)
            if not halo:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "tile"])
                continue
            m = HALO * tiles.gap
            row, near = np.tile(np.arange(len(x)), 8), np.concatenate([tiles.tile(x + i * m, y + j * m) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
            pairs = np.unique(np.stack([row, near], 1)[near != own[row]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x[pairs[:, 0]]), pa.array(y[pairs[:, 0]]), pa.array(pairs[:, 1])], schema=schema)

    kinds = "".join(f", `{c}` {points.schema[c].dataType.simpleString()}" for c in others)
    picked = points.select("x", "y", *(() if halo else others))
    return picked.mapInArrow(run, f"x double, y double{'' if halo else kinds}, tile long")


def _local(table: pa.Table, tiles: Layout, frame: list[tuple[float, float]]) -> pa.Table:
    """The triangles at one tile's own points, among these and others that it knows: rows of _STATE."""
    tile = table["tile"][0].as_py()
    own = {p for p, o in zip(zip(table["x"].to_pylist(), table["y"].to_pylist()), table["own"].to_pylist()) if o}
    points = sorted({*zip(table["x"].to_pylist(), table["y"].to_pylist()), *frame})
    mine = [p in own for p in points]
    corners, ghost, whose = [], [], []
    for (i, j), k in triangulate(points).items():
        if _GHOST in (i, j) or (k != _GHOST and (i > j or i > k)) or not (mine[i] or mine[j] or (k != _GHOST and mine[k])):
            continue  # each triangle comes once, from its least corner
        corners.append((*points[i], *points[j], *(points[k] if k != _GHOST else points[i])))
        ghost.append(k == _GHOST)
        whose.append((mine[i], mine[j], k != _GHOST and mine[k]))
    t, is_ghost = np.array(corners, float).reshape(-1, 6), np.array(ghost, bool)
    x, y, r = circle(t)
    x0, x1, y0, y1 = tiles.box(tile)
    with np.errstate(invalid="ignore"):
        sure = ~is_ghost & (x - r * (1 + 1e-9) > x0) & (x + r * (1 + 1e-9) < x1) & (y - r * (1 + 1e-9) > y0) & (y + r * (1 + 1e-9) < y1)
    ask = []
    for k in range(len(t)):
        if sure[k]:
            ask.append([])
            continue
        low, high = tiles.low, tiles.high
        if is_ghost[k] or not np.isfinite(r[k]):
            near = tiles.touched(low[0], high[0], low[1], high[1])
        else:
            reach = r[k] * (1 + 1e-6)
            near = tiles.touched(max(low[0], x[k] - reach), min(high[0], x[k] + reach), max(low[1], y[k] - reach), min(high[1], y[k] + reach))
        ask.append([q for q in near if q != tile and _meets(t[k], is_ghost[k], (x[k], y[k], r[k]), tiles.box(q), low, high)])
    columns = [pa.array(np.full(len(t), tile)), pa.array(np.arange(len(t))), *(pa.array(t[:, c]) for c in range(6)), pa.array(is_ghost), pa.array([w[0] and not g for w, g in zip(whose, ghost)], pa.bool_()), pa.array(whose, pa.list_(pa.bool_())), pa.array(ask, pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, names=["tile", "k", *_CORNERS, "ghost", "own", "whose", "ask"])


_STATE = f"tile long, k long, {', '.join(f'{c} double' for c in _CORNERS)}, ghost boolean, own boolean, whose array<boolean>, ask array<long>"


def _meets(t: np.ndarray, ghost: bool, around: tuple[float, float, float], box: tuple[float, float, float, float], low, high) -> bool:
    """Whether points of a box may lie in a triangle's circle, or beyond its hull edge; may be true of too many."""
    x0, x1, y0, y1 = max(box[0], low[0]), min(box[1], high[0]), max(box[2], low[1]), min(box[3], high[1])
    if ghost:
        return any((t[2] - t[0]) * (y - t[1]) - (t[3] - t[1]) * (x - t[0]) >= -1e-9 * (abs(t[2] - t[0]) + abs(t[3] - t[1])) * (1 + abs(x) + abs(y)) for x in (x0, x1) for y in (y0, y1))
    x, y, r = around
    return not math.isfinite(r) or math.hypot(x - min(max(x, x0), x1), y - min(max(y, y0), y1)) <= r * (1 + 1e-6)


def _witnesses(asked: pa.Table, points: pa.Table) -> pa.Table:
    """For each asked triangle the point of this tile deepest in its circle, or furthest beyond its hull edge, if any is."""
    px, py = (points[c].to_numpy() for c in ("x", "y"))
    out = []
    t = np.stack([asked[c].to_numpy() for c in _CORNERS], 1).reshape(-1, 6) if len(asked) else np.zeros((0, 6))
    for row, ghost, tile, k in zip(t.tolist(), asked["ghost"].to_pylist(), asked["tile"].to_pylist(), asked["k"].to_pylist()):
        a, b, c = (row[0], row[1]), (row[2], row[3]), (row[4], row[5])
        if ghost:
            depth = (b[0] - a[0]) * (py - a[1]) - (b[1] - a[1]) * (px - a[0])
            slack = 1e-12 * (abs(b[0] - a[0]) + abs(b[1] - a[1])) * (1 + np.abs(px) + np.abs(py) + abs(a[0]) + abs(a[1]))
        else:
            u = [(p[0] - px, p[1] - py) for p in (a, b, c)]
            z = [x * x + y * y for x, y in u]
            pairs = [(u[1], u[2]), (u[2], u[0]), (u[0], u[1])]
            depth = sum(w * (p[0] * q[1] - p[1] * q[0]) for w, (p, q) in zip(z, pairs))
            slack = 1e-12 * sum(w * (np.abs(p[0] * q[1]) + np.abs(p[1] * q[0])) for w, (p, q) in zip(z, pairs))
        for m in np.flatnonzero(depth >= -slack)[np.argsort(-depth[depth >= -slack], kind="stable")].tolist():
            p = (float(px[m]), float(py[m]))
            if p not in (a, b, c) and (_beyond(a, b, p) if ghost else in_circle(a, b, c, p)):
                out.append((tile, k, p[0], p[1], float(depth[m])))
                break
    columns = list(zip(*out)) if out else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["tile", "k", "x", "y", "depth"])


def delaunay(points: DataFrame, tile: int = TILE) -> DataFrame:
    """The Delaunay triangles of points (x, y): ax, ay, bx, by, cx, cy, which turn left and begin at the least corner.

    Points that are null or not finite are left out, repeated ones are one; fewer than three, or all on one line, have no
    triangles; other columns are ignored. Of points on one circle, ties go by position (see in_circle), so the result does
    not depend on tiles.

    Tiles of about `tile` points triangulate their points and some beyond their edges. A triangle whose circle leaves the
    tile asks the tiles that the circle meets for points in it; hull edges ask those beyond. A point at which no triangle
    was told of any is done. The others begin again with what they were told of and the corners of their triangles: these
    bound their cells, so no other known point can matter. So what is returned is proven, each triangle by the tile of its
    least corner, and no task holds more than a tile, its surroundings and what it was told of. Each round works on the
    points not yet done alone.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < math.inf) & (F.abs(y) < math.inf)
    rows = written(points.select((x + 0.0).alias("x"), (y + 0.0).alias("y")).where(finite).distinct())
    tiles, frame = layout(rows, tile), []
    if tiles:
        ends = rows.agg(F.min(F.struct("x", "y")), F.max(F.struct("x", "y"))).first()
        (ax, ay), (bx, by) = ends[0], ends[1]
        off = F.abs((F.col("y") - ay) * (bx - ax) - (F.col("x") - ax) * (by - ay))
        far = rows.orderBy(off.desc(), "x", "y").first()
        frame = [(ax, ay), (bx, by), (far.x, far.y)] if orient((ax, ay), (bx, by), (far.x, far.y)) else []
    if not frame:
        return rows.sparkSession.createDataFrame([], ", ".join(f"{c} double" for c in _CORNERS))
    own, done = written(tiled(rows, tiles)), None
    parts = tiles.parts(rows.sparkSession)
    work = own.withColumn("own", F.lit(True)).unionByName(tiled(rows, tiles, halo=True).withColumn("own", F.lit(False)))
    while True:
        state = written(work.repartition(parts, "tile").groupBy("tile").applyInArrow(lambda table: _local(table, tiles, frame), _STATE))
        asked = state.where(F.size("ask") > 0).select("tile", "k", *_CORNERS, "ghost", F.explode("ask").alias("at"))
        beside = own.withColumnRenamed("tile", "of").join(asked.select(F.col("at").alias("of")).distinct(), "of", "left_semi")
        told = asked.repartition(parts, "at").groupBy("at").cogroup(beside.repartition(parts, "of").groupBy("of")).applyInArrow(_witnesses, "tile long, k long, x double, y double, depth double")
        told = written(told.groupBy("tile", "k").agg(F.max(F.struct("depth", "x", "y")).alias("w")).select("tile", "k", "w.x", "w.y"))
        # a point is open as long as one of the triangles at it is not proven
        open_ = written(_corners(state.join(told, ["tile", "k"], "left_semi")).where("mine").select("tile", "x", "y").distinct())
        right = state.where("own").join(open_.select("tile", F.col("x").alias("ax"), F.col("y").alias("ay")), ["tile", "ax", "ay"], "left_anti").select(*_CORNERS)
        done = right if done is None else done.unionByName(right)
        if open_.isEmpty():
            return done
        near = _corners(state).join(open_, ["tile", "x", "y"], "left_semi").select("tile", "k").distinct()
        around = _corners(state.join(near, ["tile", "k"], "left_semi")).select("tile", "x", "y").unionByName(told.select("tile", "x", "y")).distinct()
        work = written(open_.withColumn("own", F.lit(True)).unionByName(around.withColumn("own", F.lit(False))))


def _corners(state: DataFrame) -> DataFrame:
    """tile, k, x, y, mine: whether the corner is one of the tile's own points."""
    three = [F.struct(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"), F.col("whose")[k].alias("mine")) for k, c in enumerate("abc")]
    return state.select("tile", "k", F.explode(F.array(*three)).alias("c")).select("tile", "k", "c.*")


def interpolate(points: DataFrame, targets: DataFrame, tile: int = TILE) -> DataFrame:
    """targets (x, y and others) with `val`: the linear interpolation of points (x, y, val) in the Delaunay triangle around,
    null outside the hull.

    Points at one place count by their mean; points or values that are null are left out, and targets without a place
    have no value. A target on an edge gets what either side gives, up to rounding; the triangle of least corners decides.
    """
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND val IS NOT NULL").groupBy((F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y")).agg(F.avg("val").alias("val"))
    known = written(known)
    corners = delaunay(known, tile)
    for c in "abc":
        value = known.select(F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("val").alias(f"{c}v"))
        corners = corners.join(value, [f"{c}x", f"{c}y"])
    tiles = layout(known, tile)
    rows = targets.withColumn("target", F.monotonically_increasing_id())
    rows = written(rows)
    placed = rows.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "target")
    if tiles is None:
        return rows.drop("target").withColumn("val", F.lit(None).cast("double"))
    names = [*_CORNERS, "av", "bv", "cv"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.stack([batch.column(k).to_numpy() for k in range(6)], 1)
            xs, ys = t[:, ::2], t[:, 1::2]
            found = [tiles.touched(*box) for box in zip(xs.min(1), xs.max(1), ys.min(1), ys.max(1))]
            own = np.repeat(np.arange(len(t)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns), pa.array([q for f in found for q in f], pa.int64())], names=[*names, "tile"])

    def inside(triangles: pa.Table, asked: pa.Table) -> pa.Table:
        t = np.stack([triangles[c].to_numpy() for c in names], 1) if len(triangles) else np.zeros((0, 9))
        t = t[np.lexsort(t[:, 5::-1].T)]
        px, py = asked["x"].to_numpy(), asked["y"].to_numpy()
        order = np.argsort(px, kind="stable")
        value, seen = np.full(len(px), np.nan), np.zeros(len(px), bool)
        lows, highs = np.searchsorted(px[order], t[:, :6:2].min(1), "left"), np.searchsorted(px[order], t[:, :6:2].max(1), "right")
        for (ax, ay, bx, by, cx, cy, av, bv, cv), lo, hi in zip(t.tolist(), lows.tolist(), highs.tolist()):
            m = order[lo:hi]
            area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            b = ((px[m] - ax) * (cy - ay) - (py[m] - ay) * (cx - ax)) / area
            c = ((bx - ax) * (py[m] - ay) - (by - ay) * (px[m] - ax)) / area
            hit = (b >= -1e-12) & (c >= -1e-12) & (b + c <= 1 + 1e-12) & ~seen[m]
            value[m[hit]] = ((1 - b - c) * av + b * bv + c * cv)[hit]
            seen[m[hit]] = True
        return pa.Table.from_arrays([asked["target"].combine_chunks().filter(pa.array(seen)), pa.array(value[seen])], names=["found", "val"])

    parts = tiles.parts(rows.sparkSession)
    spread = corners.select(*names).mapInArrow(cells, f"{', '.join(f'{c} double' for c in names)}, tile long")
    found = spread.repartition(parts, "tile").groupBy("tile").cogroup(tiled(placed, tiles).withColumnRenamed("tile", "of").repartition(parts, "of").groupBy("of")).applyInArrow(inside, "found long, val double")
    return rows.join(found, rows.target == found.found, "left").drop("target", "found")
