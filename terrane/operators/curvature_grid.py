"""Gridding by minimum curvature with tension: blocks of the grid are solved exactly, again and again, from what lies around."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import parts_for, written

#: Nodes along the side of a block, and how far the part it solves reaches into its neighbours.
BLOCK, OVERLAP = 64, 24
_RING = 2  # nodes beyond, that the stencils reach
#: Steps of conjugate gradients that a block may take, and the share of the pull at which it counts as solved: what comes to
#: that in so few steps is as exact as elimination.
STEPS, STILL = 300, 1e-11
_ROWS = "bi long, bj long, known binary, value binary"


def stencils(tension: float) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """The squares that the surface makes least: weight, and (row, column, factor) of the nodes of a difference."""
    bend = 1.0 - tension
    out = [
        (bend, [(0, 0, 1.0), (0, 1, -2.0), (0, 2, 1.0)]),
        (bend, [(0, 0, 1.0), (1, 0, -2.0), (2, 0, 1.0)]),
        (2 * bend, [(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 1.0)]),
        (tension, [(0, 0, -1.0), (0, 1, 1.0)]),
        (tension, [(0, 0, -1.0), (1, 0, 1.0)]),
    ]
    return [s for s in out if s[0]]


def solve(value: np.ndarray, free: np.ndarray, tension: float, ridge: float = 1e-9) -> np.ndarray:
    """value with its free nodes moved to where the sum of weighted squares over the array is least. A slight pull to the
    values at the start makes the answer unique; it is nil once they are the answer.

    The normal equations link rows at most two apart: taken two rows at a time they are block tridiagonal.
    """
    h, w = value.shape
    if not free.any():
        return value
    pairs = -(-h // 2)
    main, upper, right = np.zeros((pairs, 2 * w, 2 * w)), np.zeros((pairs, 2 * w, 2 * w)), np.zeros((pairs, 2 * w))
    node = np.arange(h * w).reshape(h, w)
    loose, flat = free.ravel(), value.ravel()
    group, place = (node // w // 2).ravel(), ((node // w % 2) * w + node % w).ravel()
    for weight, parts in stencils(tension):
        down, along = max(p[0] for p in parts), max(p[1] for p in parts)
        if h <= down or w <= along:
            continue
        at = [node[i : h - down + i, j : w - along + j].ravel() for i, j, _ in parts]
        for a, (_, _, x) in zip(at, parts):
            for b, (_, _, y) in zip(at, parts):
                on = loose[a]
                both = on & loose[b]
                same, next_ = both & (group[a] == group[b]), both & (group[b] == group[a] + 1)
                np.add.at(main, (group[a[same]], place[a[same]], place[b[same]]), weight * x * y)
                np.add.at(upper, (group[a[next_]], place[a[next_]], place[b[next_]]), weight * x * y)
                fixed = on & ~loose[b]
                np.add.at(right, (group[a[fixed]], place[a[fixed]]), -weight * x * y * flat[b[fixed]])
    own = np.flatnonzero(loose)
    main[group[own], place[own], place[own]] += ridge
    right[group[own], place[own]] += ridge * flat[own]
    idle = np.ones((pairs, 2 * w), bool)
    idle[group[own], place[own]] = False
    g, p = np.nonzero(idle)
    main[g, p, p] = 1.0
    for k in range(1, pairs):
        factor = np.linalg.solve(main[k - 1], np.column_stack([upper[k - 1], right[k - 1]]))
        main[k] -= upper[k - 1].T @ factor[:, :-1]
        right[k] -= upper[k - 1].T @ factor[:, -1]
    x = np.zeros((pairs, 2 * w))
    x[-1] = np.linalg.solve(main[-1], right[-1])
    for k in range(pairs - 2, -1, -1):
        x[k] = np.linalg.solve(main[k], right[k] - upper[k] @ x[k + 1])
    out = flat.copy()
    out[own] = x[group[own], place[own]]
    return out.reshape(h, w)


def nearer(value: np.ndarray, free: np.ndarray, tension: float) -> np.ndarray:
    """What solve gives, by conjugate gradients: where known nodes lie close to all others, these need far less than
    elimination does. What has not come to STILL of its size in STEPS is solved directly."""
    if not free.any():
        return value
    w, n, held = value.shape[1], value.size, value[~free]
    loose, middle = free.ravel(), held.mean() if held.size else value.mean()
    # rows lie one behind another: differences along them have no weight where they would run on into the next row
    after, pull_of_first = w - 1 - np.arange(n) % w, tension / (1.0 - tension)
    first_j, second_j, both = (after[: n - 1] > 0) * pull_of_first, (after[: max(n - 2, 0)] > 1) * 1.0, (after[: max(n - 1 - w, 0)] > 0) * 2.0
    gj, gi, jj, ij, ii = np.zeros(n - 1), np.zeros(n - w), np.zeros(second_j.size), np.zeros(both.size), np.zeros(max(n - 2 * w, 0))

    def pull(x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Half the slope of the sum of squares over 1 - tension, from first differences and differences of these."""
        np.subtract(x[1:], x[:-1], gj)
        np.subtract(x[w:], x[:-w], gi)
        np.subtract(gj[1:], gj[:-1], jj)
        np.subtract(gj[w:], gj[:-w], ij)
        np.subtract(gi[w:], gi[:-w], ii)
        for part, weight in ((jj, second_j), (ij, both), (gj, first_j), (gi, pull_of_first)):
            np.multiply(part, weight, part)
        for whole, part, by in ((gj, jj, 1), (gj, ij, w), (gi, ii, w)):
            whole[by:] += part
            whole[:-by] -= part
        out[0] = 0.0
        out[1:] = gj
        out[:-1] -= gj
        out[w:] += gi
        out[:-w] -= gi
        return out

    size = np.zeros(n)
    for part, factors, by in ((second_j, (1, 4, 1), 1), (np.ones(ii.size), (1, 4, 1), w), (first_j, (1, 1), 1), (np.full(gi.size, pull_of_first), (1, 1), w)):
        for k, x in enumerate(factors):
            size[k * by : k * by + part.size] += x * part
    for at in (0, 1, w, w + 1):
        size[at : at + both.size] += both
    scale = np.zeros(n)
    np.divide(1.0, size, scale, where=loose & (size > 0))
    x, bent, step = value.ravel() - middle, np.zeros(n), np.zeros(n)
    known = pull(np.where(loose, 0.0, x), bent)
    small = np.vdot(known, known * scale)
    left = -pull(x, np.zeros(n))
    np.multiply(left, scale, step)
    now, way = np.vdot(left, step), step.copy()
    small = max(STILL**2 * max(now, small), (1e-14 * np.abs(x).max()) ** 2)
    for _ in range(STEPS):
        if now <= small:
            return np.where(free, x.reshape(value.shape) + middle, value)
        pull(way, bent)
        along = np.vdot(way, bent)
        if not along > 0:
            break
        np.multiply(way, now / along, step)
        x += step
        bent *= now / along
        left -= bent
        np.multiply(left, scale, step)
        before, now = now, np.vdot(left, step)
        way *= now / before
        way += step
    return solve(value, free, tension)


class _Grid:
    """A rectangle of nodes in blocks; the last ones of a row or column are partly outside."""

    def __init__(self, rows: int, columns: int, block: int, overlap: int):
        self.rows, self.columns, self.block, self.overlap = rows, columns, block, overlap
        self.bi, self.bj = -(-rows // block), -(-columns // block)

    def array(self, data: bytes, kind=np.float64) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(self.block, self.block)

    def side(self, step: int, reach: int) -> slice:
        """Rows (or columns) of a block that lie within `reach` of the one `step` blocks on."""
        return (slice(0, reach), slice(0, self.block), slice(self.block - reach, self.block))[step + 1]

    def ring(self, di: int, dj: int, reach: int) -> list[tuple[slice, slice]]:
        """The nodes of a block that the one (di, dj) on holds still: the outermost of those within its reach."""
        i, j = self.side(di, reach), self.side(dj, reach)
        last = [slice(s.stop - _RING, s.stop) if d < 0 else slice(s.start, s.start + _RING) for d, s in ((di, i), (dj, j))]
        return ([(last[0], j)] if di else []) + ([(i, last[1])] if dj else [])


def _dealt(blocks: DataFrame, todo: DataFrame | None, grid: _Grid, reach: int) -> DataFrame:
    """Of each block what lies within `reach` nodes of those beside it, and itself: ti, tj say whose surroundings it is; all
    blocks', or those of todo (bi, bj)."""
    if todo is None:
        rows = blocks.withColumn("to", F.array(*(F.lit(k) for k in range(9))))
    else:
        steps = F.explode(F.array(*(F.lit(k) for k in range(9)))).alias("k")
        sent = todo.select("bi", "bj", steps).select((F.col("bi") + 1 - F.floor(F.col("k") / 3)).alias("bi"), (F.col("bj") + 1 - F.col("k") % 3).alias("bj"), "k")
        rows = blocks.join(sent.groupBy("bi", "bj").agg(F.collect_list("k").alias("to")), ["bi", "bj"])
    schema = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("known", pa.binary()), ("value", pa.binary()), ("ti", pa.int64()), ("tj", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, k, v, to in zip(*(batch.column(c) for c in range(5))):
                bi, bj, k, v, out = bi.as_py(), bj.as_py(), grid.array(k.as_py(), np.bool_), grid.array(v.as_py()), []
                for step in to.as_py():
                    ti, tj = bi + step // 3 - 1, bj + step % 3 - 1
                    if 0 <= ti < grid.bi and 0 <= tj < grid.bj:
                        cut = grid.side(step // 3 - 1, reach), grid.side(step % 3 - 1, reach)
                        out.append((bi, bj, k[cut].tobytes(), v[cut].tobytes(), ti, tj))
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    out = rows.select("bi", "bj", "known", "value", "to").mapInArrow(run, f"{_ROWS}, ti long, tj long")
    # a fixed number of tasks: the work of a block is far more than its bytes, by which Spark would put tasks together
    n = grid.bi * grid.bj
    return out.repartition(min(n, parts_for(blocks.sparkSession, n * grid.block**2)), "ti", "tj")


def _around(table: pa.Table, grid: _Grid, reach: int) -> tuple[int, int, np.ndarray, np.ndarray, int, int]:
    """Of what was dealt to (ti, tj): row, column, values and known nodes of it and `reach` nodes around it within the grid, and where it begins there."""
    ti, tj, block = table["ti"][0].as_py(), table["tj"][0].as_py(), grid.block
    i0, j0 = max(0, ti * block - reach), max(0, tj * block - reach)
    i1, j1 = min(grid.rows, (ti + 1) * block + reach), min(grid.columns, (tj + 1) * block + reach)
    value, known = np.zeros((i1 - i0, j1 - j0)), np.zeros((i1 - i0, j1 - j0), bool)
    for bi, bj, k, v in zip(*(table[c].to_pylist() for c in ("bi", "bj", "known", "value"))):
        rows, columns = grid.side(ti - bi, reach), grid.side(tj - bj, reach)
        i, j, shape = bi * block + rows.start - i0, bj * block + columns.start - j0, (rows.stop - rows.start, columns.stop - columns.start)
        to = value[i : i + shape[0], j : j + shape[1]]
        to[:] = np.frombuffer(v).reshape(shape)[: to.shape[0], : to.shape[1]]
        known[i : i + shape[0], j : j + shape[1]] = np.frombuffer(k, np.bool_).reshape(shape)[: to.shape[0], : to.shape[1]]
    return ti, tj, value, known, ti * block - i0, tj * block - j0


def _round(blocks: DataFrame, todo: DataFrame | None, grid: _Grid, tension: float) -> DataFrame:
    """The blocks of todo (None: all) solved with OVERLAP nodes around them, what lies beyond held as it is, and the others;
    moved: for each of the blocks around, the most that a node moved which that one holds."""
    schema = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("known", pa.binary()), ("value", pa.binary()), ("moved", pa.list_(pa.float64()))])
    reach = grid.overlap + _RING

    def one(table: pa.Table) -> pa.Table:
        ti, tj, value, known, i, j = _around(table, grid, reach)
        free, h, w = ~known, *value.shape
        # the ring holds still, but for the edge of the whole grid, beyond which there is nothing
        if ti * grid.block - reach >= 0:
            free[:_RING] = False
        if tj * grid.block - reach >= 0:
            free[:, :_RING] = False
        if (ti + 1) * grid.block + reach <= grid.rows:
            free[h - _RING :] = False
        if (tj + 1) * grid.block + reach <= grid.columns:
            free[:, w - _RING :] = False
        after = nearer(value, free, tension)
        own, change = np.zeros((grid.block, grid.block)), np.zeros((grid.block, grid.block))
        part = after[i : i + grid.block, j : j + grid.block]
        own[: part.shape[0], : part.shape[1]] = part
        change[: part.shape[0], : part.shape[1]] = np.abs(part - value[i : i + grid.block, j : j + grid.block])
        mask = np.zeros((grid.block, grid.block), bool)
        mask[: part.shape[0], : part.shape[1]] = known[i : i + grid.block, j : j + grid.block]
        moved = [max(change[a, b].max(initial=0.0) for a, b in grid.ring(k // 3 - 1, k % 3 - 1, reach)) if k != 4 else 0.0 for k in range(9)]
        return pa.Table.from_arrays([pa.array([ti]), pa.array([tj]), pa.array([mask.tobytes()]), pa.array([own.tobytes()]), pa.array([moved], pa.list_(pa.float64()))], schema=schema)

    solved = _dealt(blocks, todo, grid, reach).groupBy("ti", "tj").applyInArrow(one, f"{_ROWS}, moved array<double>")
    if todo is None:
        return solved
    return solved.unionByName(blocks.join(todo, ["bi", "bj"], "left_anti").withColumn("moved", F.array(*(F.lit(0.0) for _ in range(9)))))


def _called(solved: DataFrame, grid: _Grid, enough: float) -> DataFrame:
    """The blocks (bi, bj) that hold a node which moved by more than `enough`."""
    far = solved.select("bi", "bj", F.posexplode("moved").alias("k", "most")).where(F.col("most") > enough)
    out = far.select((F.col("bi") + F.floor(F.col("k") / 3) - 1).alias("bi"), (F.col("bj") + F.col("k") % 3 - 1).alias("bj"))
    return out.where(F.col("bi").between(0, grid.bi - 1) & F.col("bj").between(0, grid.bj - 1)).distinct()


def _start(nodes: DataFrame, grid: _Grid, fill: float) -> DataFrame:
    """nodes (i, j, val: known) as blocks, unknown ones at `fill`; a row for every block."""
    spark = nodes.sparkSession
    every = spark.range(grid.bi * grid.bj).select((F.col("id") / grid.bj).cast("long").alias("bi"), (F.col("id") % grid.bj).alias("bj"))
    cells = nodes.withColumn("bi", F.floor(F.col("i") / grid.block)).withColumn("bj", F.floor(F.col("j") / grid.block))
    schema = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("known", pa.binary()), ("value", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        known, value = np.zeros((grid.block, grid.block), bool), np.full((grid.block, grid.block), fill)
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        told = table.filter(pa.compute.is_valid(table["val"]))
        i, j = told["i"].to_numpy() - bi * grid.block, told["j"].to_numpy() - bj * grid.block
        value[i, j], known[i, j] = told["val"].to_numpy(), True
        return pa.Table.from_arrays([pa.array([bi]), pa.array([bj]), pa.array([known.tobytes()]), pa.array([value.tobytes()])], schema=schema)

    none = every.select("bi", "bj", F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("val"))
    return cells.select("bi", "bj", "i", "j", "val").unionByName(none).groupBy("bi", "bj").applyInArrow(pack, _ROWS)


def _finer(coarse: DataFrame, fine: DataFrame, grid: _Grid, above: _Grid) -> DataFrame:
    """fine's unknown nodes at what lies at their place in the grid of half the nodes a side."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("s")
    sent = coarse.select("*", steps).select((2 * F.col("bi") + F.col("s.i")).alias("bi"), (2 * F.col("bj") + F.col("s.j")).alias("bj"), F.col("value").alias("above"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bi, bj, k, v, up in zip(*(batch.column(c).to_pylist() for c in range(5))):
                i, j = (bi % 2) * (grid.block // 2), (bj % 2) * (grid.block // 2)
                spread = np.repeat(np.repeat(grid.array(up)[i : i + grid.block // 2, j : j + grid.block // 2], 2, 0), 2, 1)
                rows.append((bi, bj, k, np.where(grid.array(k, np.bool_), grid.array(v), spread).tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bi", "bj", "known", "value"])

    return fine.join(sent, ["bi", "bj"]).select("bi", "bj", "known", "value", "above").mapInArrow(run, _ROWS)


def fill(nodes: DataFrame, tension: float = 0.0, accuracy: float = 1e-6, most_rounds: int = 400, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """Every node of the grid that nodes (inl, crl: whole numbers, val) span, by rows and columns from the least to the
    greatest: inl, crl, val, known.

    Known values stay (several at one node: their mean); null values, and rows with a null position, are none. The others
    make the sum of squared second differences, times 1 - tension, and of squared first differences, times tension (0 to
    1, not 1), least; so the surface is free at the grid's edges. Without any known value all are null; an empty table
    gives no rows; other columns are ignored.

    The grid is cut in blocks. In a round each block of `block` nodes a side is solved exactly together with `overlap` nodes (less than a block) around it, all beyond
    held at what the round before left. A block is solved again while a node that it holds has moved by more than
    `accuracy` times the range of known values; rounds end when none is (RuntimeError after most_rounds). Grids of half as
    many nodes a side are solved before, down to one block, to start from. A round shuffles to each block's neighbours what
    lies within their reach; a task holds one block and its surroundings at a time.
    """
    if not (0 <= tension < 1 and 0 < overlap <= block - _RING):
        raise ValueError("tension is 0 or more and less than 1, the overlap less than a block")
    rows = nodes.select(F.col("inl").cast("long").alias("inl"), F.col("crl").cast("long").alias("crl"), F.col("val").cast("double").alias("val")).where("inl IS NOT NULL AND crl IS NOT NULL")
    rows = written(rows.groupBy("inl", "crl").agg(F.avg("val").alias("val")))
    i0, i1, j0, j1, low, high, mean = rows.agg(F.min("inl"), F.max("inl"), F.min("crl"), F.max("crl"), F.min("val"), F.max("val"), F.avg("val")).first()
    if i0 is None or low is None:
        span = rows.select("inl", "crl", "val", F.lit(False).alias("known"))
        return span if i0 is None else _listed(_start(rows.select((F.col("inl") - i0).alias("i"), (F.col("crl") - j0).alias("j"), "val"), g := _Grid(i1 - i0 + 1, j1 - j0 + 1, block, overlap), 0.0), g, i0, j0).withColumn("val", F.lit(None).cast("double"))
    at = rows.where("val IS NOT NULL").select((F.col("inl") - i0).alias("i"), (F.col("crl") - j0).alias("j"), "val")
    grids = [_Grid(i1 - i0 + 1, j1 - j0 + 1, block, overlap)]
    while grids[-1].bi * grids[-1].bj > 1:
        grids.append(_Grid(-(-grids[-1].rows // 2), -(-grids[-1].columns // 2), block, overlap))
    layers = [at.select("i", "j", F.col("val").alias("s"), F.lit(1).cast("long").alias("n"))]
    for _ in grids[1:]:
        half = [F.floor(F.col(c) / 2).alias(c) for c in "ij"]
        layers.append(written(layers[-1].groupBy(*half).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))))
    blocks, above = None, None
    for level in range(len(grids) - 1, -1, -1):
        grid = grids[level]
        start = _start(layers[level].select("i", "j", (F.col("s") / F.col("n")).alias("val")), grid, mean)
        blocks = written(start if blocks is None else _finer(blocks, start, grid, above))
        enough = max((high - low) * accuracy * (100 if level else 1), 1e-300)
        todo = None
        for _ in range(most_rounds):
            solved = written(_round(blocks, todo, grid, tension))
            blocks = solved.drop("moved")
            if grid.bi * grid.bj == 1 or (todo := written(_called(solved, grid, enough))).isEmpty():
                break
        else:
            raise RuntimeError(f"the surface still moves after {most_rounds} rounds")
        above = grid
    return _listed(blocks, grids[0], i0, j0)


def _listed(blocks: DataFrame, grid: _Grid, i0: int, j0: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, k, v in zip(*(batch.column(c).to_pylist() for c in range(4))):
                h, w = min(grid.block, grid.rows - bi * grid.block), min(grid.block, grid.columns - bj * grid.block)
                i, j = np.mgrid[bi * grid.block : bi * grid.block + h, bj * grid.block : bj * grid.block + w]
                columns = [(i + i0).ravel(), (j + j0).ravel(), grid.array(v)[:h, :w].ravel(), grid.array(k, np.bool_)[:h, :w].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["inl", "crl", "val", "known"])

    return blocks.select("bi", "bj", "known", "value").mapInArrow(run, "inl long, crl long, val double, known boolean")
