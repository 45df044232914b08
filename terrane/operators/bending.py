"""Rays that bend at layer boundaries by Snell's law, modes of traces by sifting, and fault surfaces from sticks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ray_parameters(thickness: np.ndarray, velocity: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The ray parameter p of each row's ray down through its layers (0 thick: none) and up again over the offset: the root
    of sum(2 h p v / sqrt(1 - p^2 v^2)) = offset, which rises with p.

    With p = sin(a) / v for the fastest layer and t = tan(a), it is bracketed by the offset over that layer alone. What t
    reaches bends down as t grows, so that Newton's steps rise to the root from below; the bracket is halved where a step
    does not bring it to neighbouring numbers.
    """
    real = thickness > 0
    fast = np.where(real, velocity, 0).max(1)
    slow = np.where(real, velocity, 1.0) / np.where(fast > 0, fast, 1.0)[:, None]

    # sin(a) of a layer is slow * t / sqrt(1 + t^2); its tangent without cancellation for steep rays
    depth = np.where(real & (slow == 1), thickness, 0).sum(1)
    low, high = np.zeros(len(offset)), np.where(depth > 0, offset / (2 * np.where(depth > 0, depth, 1.0)) * (1 + 1e-12), 0.0)
    out, left = high.copy(), np.arange(len(offset))
    t = np.minimum(high, offset / np.maximum((2 * thickness * slow).sum(1), 1e-300))
    for k in range(200):
        root = np.sqrt(1 + t[:, None] ** 2 * (1 - slow) * (1 + slow))
        parts = 2 * thickness * slow / root
        off = offset - parts.sum(1) * t
        low, high = np.where(off > 0, t, low), np.where(off > 0, high, np.minimum(t, high))
        step = t + off / np.maximum((parts / (root * root)).sum(1), 1e-300)
        # every third trial halves the bracket, as steps may stand still by rounding
        step = np.where((step > low) & (step < high) & (k % 3 < 2), step, (low + high) / 2)
        done = (high - low <= 4e-16 * high) | (np.abs(off) <= 1e-15 * offset)
        out[left[done]] = np.where(np.abs(off) <= 1e-15 * offset, t, high)[done]
        if done.all():
            break
        rest = ~done
        left, t, low, high, offset, slow, thickness = left[rest], step[rest], low[rest], high[rest], offset[rest], slow[rest], thickness[rest]
    else:
        out[left] = high
    high = out
    return high / np.sqrt(1 + high * high) / np.where(fast > 0, fast, np.nan)


def bending_rays(layers: DataFrame, offsets: list[float]) -> DataFrame:
    """model, layer, offset, p, twt and angle (radians, of incidence at the layer's bottom) of the ray that is reflected at the
    bottom of each layer and comes up at each offset (0 or more), for layers (model, layer: order from the top, thickness, vp).

    Snell's law holds at every boundary: sin(angle) / vp is p in all layers of a ray. Layers of null or no thickness, or
    without a velocity, bend nothing, and have no rays of their own; negative velocities count as none. A task holds one
    batch of layers, in order, and the model that it ends in; their rays are traced some at a time.
    """
    real = layers.select("model", "layer", F.col("thickness").cast("double").alias("h"), F.col("vp").cast("double").alias("v")).where("h > 0 AND v > 0")
    n = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = real.repartition(n, "model").sortWithinPartitions("model", "layer")
    offset = np.array(offsets, float)

    def traced(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, v = (table.column(c).to_numpy() for c in ("h", "v"))
        first = np.repeat(starts, np.diff(np.append(starts, len(h))))
        low = 0
        while low < len(h) and len(offset):
            # as many layers as make _RAYS numbers with all that lies above them
            sizes = np.arange(low, min(len(h), low + _RAYS)) - first[low : low + _RAYS] + 1
            fit = np.maximum.accumulate(sizes) * np.arange(1, len(sizes) + 1) * len(offset) <= _RAYS
            high = low + max(1, int(fit.sum()))
            sizes = sizes[: high - low]
            fill = np.arange(sizes.max()) < sizes[:, None]
            at = np.where(fill, first[low:high, None] + np.arange(sizes.max()), 0)
            hs, vs = (np.repeat(np.where(fill, c[at], other), len(offset), 0) for c, other in ((h, 0.0), (v, 1.0)))
            x, last = np.tile(offset, high - low), np.repeat(sizes - 1, len(offset))
            p = ray_parameters(hs, vs, x)
            sine = p[:, None] * vs
            twt = (2 * hs / (vs * np.sqrt(np.maximum((1 - sine) * (1 + sine), 1e-300)))).sum(1)
            angle = np.arcsin(np.minimum(sine[np.arange(len(p)), last], 1.0))
            own = table.take(pa.array(np.repeat(np.arange(low, high), len(offset))))
            names = [own.column(c).combine_chunks() for c in ("model", "layer")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(x), pa.array(p), pa.array(twt), pa.array(angle)], names=["model", "layer", "offset", "p", "twt", "angle"])
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            starts = _starts(table["model"])
            if not len(starts):
                continue
            # the last model may go on
            rest = table.slice(starts[-1])
            yield from traced(table.slice(0, starts[-1]), starts[:-1])
        if rest is not None:
            yield from traced(rest.combine_chunks(), np.zeros(1, np.int64))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"model {kinds['model']}, layer {kinds['layer']}, offset double, p double, twt double, angle double")


#: Numbers of the layers above rays that are traced at a time.
_RAYS = 1 << 18


def _starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal keys, nulls among them, begin."""
    if not len(keys):
        return np.zeros(0, np.int64)
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    differ = pa.compute.coalesce(pa.compute.not_equal(a, b), pa.compute.not_equal(a.is_null(), b.is_null()))
    return np.append(0, np.flatnonzero(differ.to_numpy()) + 1)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y) at other places; x rises; a line through two points."""
    h, n = np.diff(x), len(x)
    bend = np.zeros(n)
    if n > 2:
        slope, main = np.diff(y) / h, 2 * (h[:-1] + h[1:])
        right, upper = 6 * np.diff(slope), h[1:-1]
        for k in range(1, n - 2):
            w = upper[k - 1] / main[k - 1]
            main[k] -= w * upper[k - 1]
            right[k] -= w * right[k - 1]
        bend[n - 2] = right[-1] / main[-1]
        for k in range(n - 4, -1, -1):
            bend[k + 1] = (right[k] - upper[k] * bend[k + 2]) / main[k]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * bend[k] + (b**3 - b) * bend[k + 1]) * h[k] ** 2 / 6


def extremes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x has inner maxima and minima (of flat ones the first sample)."""
    change = np.flatnonzero(np.diff(x)) + 1
    at = np.append(0, change)[: len(x)]
    y = x[at]
    inner = np.arange(1, len(at) - 1)
    return at[inner[(y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])]], at[inner[(y[1:-1] < y[:-2]) & (y[1:-1] < y[2:])]]


def sift(x: np.ndarray, components: int, stop: float, rounds: int) -> list[np.ndarray]:
    """Modes of x, the fastest first, and what is left; they add up to x."""
    out, rest, z = [], x.astype(float), np.arange(len(x), dtype=float)
    while len(out) < components:
        tops, bottoms = extremes(rest)
        if len(tops) < 2 or len(bottoms) < 2:
            break
        mode = rest.copy()
        for _ in range(rounds):
            tops, bottoms = extremes(mode)
            if len(tops) < 2 or len(bottoms) < 2:
                break
            ends = [0, len(x) - 1]
            edge = lambda at: np.unique(np.concatenate([ends[:1], at, ends[1:]]))
            upper, lower = (spline(edge(at).astype(float), mode[np.clip(edge(at), at[0], at[-1])], z) for at in (tops, bottoms))
            mean = (upper + lower) / 2
            moved = float((mean * mean).sum() / max(float((mode * mode).sum()), 1e-300))
            mode = mode - mean
            if moved < stop:
                break
        out.append(mode)
        rest = rest - mode
    return [*out, rest]


def empirical_modes(traces: DataFrame, components: int = 4, stop: float = 0.01, rounds: int = 50) -> DataFrame:
    """trace, mode (from 0, the fastest; the last is what is left), samples: the empirical modes of traces (trace, samples).

    A mode is what is left of the signal when the mean of the spline envelopes through its maxima and its minima (held level
    to the ends) is taken off again and again, until that mean's energy is below `stop` of the mode's, or `rounds` times.
    Modes end when fewer than two maxima or minima are left, or at `components`. They add up to the trace. Null samples
    count as 0; null traces have no rows, empty ones one mode without samples.
    """
    kind = traces.schema["trace"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, mode, made = [], [], []
            for k, s in enumerate(batch.column(1)):
                if s.is_valid:
                    x = np.nan_to_num(s.values.to_numpy(zero_copy_only=False).astype(float)) if len(s) else np.zeros(0)
                    modes = sift(x, components, stop, rounds)
                    of += [k] * len(modes)
                    mode += range(len(modes))
                    made += modes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(mode, pa.int32()), pa.array(made, pa.list_(pa.float64()))], names=["trace", "mode", "samples"])

    return traces.select("trace", "samples").mapInArrow(run, f"trace {kind}, mode int, samples array<double>")


def ordered_sticks(middles: np.ndarray) -> np.ndarray:
    """Sticks in the order of their middles along the main direction in which these lie."""
    if len(middles) < 2:
        return np.arange(len(middles))
    off = middles - middles.mean(0)
    main = np.linalg.svd(off, full_matrices=False)[2][0]
    main = main * (1 if main[np.abs(main).argmax()] > 0 else -1)
    return np.lexsort((*middles.T[::-1], np.round(off @ main, 9)))


def stitched(a: np.ndarray, b: np.ndarray) -> list[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """Triangles between two polylines: corners (0 or 1, point), each step along the polyline whose new edge is the shorter."""
    if len(a) > 1 and len(b) > 1 and ((a[0] - b[0]) ** 2).sum() + ((a[-1] - b[-1]) ** 2).sum() > ((a[0] - b[-1]) ** 2).sum() + ((a[-1] - b[0]) ** 2).sum():
        flip, b = True, b[::-1]
    else:
        flip = False
    i = j = 0
    out = []
    while i + 1 < len(a) or j + 1 < len(b):
        along_a = j + 1 == len(b) or (i + 1 < len(a) and ((a[i + 1] - b[j]) ** 2).sum() <= ((a[i] - b[j + 1]) ** 2).sum())
        out.append(((0, i), (0, i + 1), (1, j)) if along_a else ((0, i), (1, j + 1), (1, j)))
        i, j = (i + 1, j) if along_a else (i, j + 1)
    return [tuple((s, len(b) - 1 - k if s and flip else k) for s, k in t) for t in out]


def fault_surfaces(points: DataFrame) -> DataFrame:
    """fault, triangle and its corners x1, y1, z1 to x3, y3, z3, of faults picked as sticks (fault, stick, seq, x, y, z).

    Sticks are put in order by their middles (see ordered_sticks), whatever their numbers; neighbours are stitched (see
    stitched), turned round where the one behind was picked the other way. Points with nulls are left out; a fault with one
    stick, or single points only, has no triangles. One task works on one fault, which holds what people have picked.
    """
    xyz = ["x", "y", "z"]
    rows = points.select("fault", "stick", F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("double").alias(c) for c in xyz)).na.drop()
    kind = rows.schema["fault"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("stick", "ascending"), ("seq", "ascending"), *((c, "ascending") for c in xyz)])
        stick, at = table["stick"].to_pylist(), np.stack([table[c].to_numpy() for c in xyz], 1)
        cuts = [0, *(k for k in range(1, len(stick)) if stick[k] != stick[k - 1]), len(stick)]
        sticks = [at[p:q] for p, q in zip(cuts, cuts[1:])]
        order = ordered_sticks(np.array([s.mean(0) for s in sticks]))
        out = []
        for p, q in zip(order, order[1:]):
            both = (sticks[p], sticks[q])
            out += [np.concatenate([both[s][k] for s, k in t]) for t in stitched(*both)]
        corners = np.array(out).reshape(-1, 9)
        return pa.Table.from_arrays([pa.array([table["fault"][0].as_py()] * len(corners), table.schema.field("fault").type), pa.array(np.arange(len(corners), dtype=np.int32)), *(pa.array(corners[:, c]) for c in range(9))], names=["fault", "triangle", *(f"{c}{k}" for k in (1, 2, 3) for c in xyz)])

    return rows.groupBy("fault").applyInArrow(one, f"fault {kind}, triangle int, {', '.join(f'{c}{k} double' for k in (1, 2, 3) for c in xyz)}")
