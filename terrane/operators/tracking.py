"""Horizon tracking: events followed from seeds from trace to trace, brick by brick of the volume."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import scratch, written

#: Traces along the side of a brick, which one task tracks through.
BRICK = 32
_NODE = "inl long, crl long, z long, score double"
_CALL = "inl long, crl long, z long, score double, from_inl long, from_crl long"


def best_shift(source: np.ndarray, target: np.ndarray, z: int, half: int, reach: int) -> tuple[float, int] | None:
    """(correlation, place) of the window of target most like source's window around z, within reach; ties go to the
    smaller shift, then upwards. None where no window lies in the trace, or all are flat."""
    lo, hi = max(half, z - reach), min(len(target) - 1 - half, z + reach)
    if lo > hi or z < half or z + half >= len(source):
        return None
    one = source[z - half : z + half + 1]
    one = one - one.mean()
    windows = np.lib.stride_tricks.sliding_window_view(target[lo - half : hi + half + 1], 2 * half + 1)
    windows = windows - windows.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = windows @ one / np.sqrt((windows * windows).sum(1) * (one @ one))
    like = np.where(np.isfinite(like), np.round(like, 12), -2.0)
    at = min(range(len(like)), key=lambda k: (-like[k], abs(lo + k - z), lo + k))
    return (float(like[at]), lo + at) if like[at] > -2 else None


def _grow(traces: dict, tracked: set, calls: list, half: int, reach: int, least: float, inside) -> tuple[list, list]:
    """New nodes of a brick, best first; and what traces of other bricks are called from them: (inl, crl, z, score, from)."""
    heap = [(-score, source, node, z) for node, z, score, source in calls if node in traces]
    heapq.heapify(heap)
    new, out = [], []
    while heap:
        score, source, node, z = heapq.heappop(heap)
        if node in tracked:
            continue
        tracked.add(node)
        new.append((*node, z, -score))
        for step in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            other = (node[0] + step[0], node[1] + step[1])
            if not inside(other):
                out.append((*other, z, *node))
            elif other in traces and other not in tracked:
                found = best_shift(traces[node], traces[other], z, half, reach)
                if found and found[0] >= least:
                    heapq.heappush(heap, (-found[0], node, other, found[1]))
    return new, out


def track(volume: DataFrame, seeds: DataFrame, half: int = 4, reach: int = 3, least: float = 0.8, brick: int = BRICK) -> DataFrame:
    """inl, crl, z, score of every trace that is reached from seeds (inl, crl, z: sample number) through volume (inl, crl,
    samples: array of doubles).

    From a tracked trace its four neighbours are reached where a window of 2 * half + 1 samples correlates, over shifts up
    to reach, with the tracked one by `least` at least; the best shift gives z, and the correlation score (1 for seeds).
    Of several ways to one trace the one that correlates best counts, then the one from the lesser trace. Samples that
    are null count as 0; traces with null positions and repeated traces but the first by their samples are left out, and
    so are seeds without a trace or too near its ends. No seeds, or an empty volume, give no rows.

    The volume is stored by bricks. A round reads only bricks that something calls to: each grows from there as far as it
    goes within the brick, best ways first, and calls to the neighbours of its edge with the samples around its horizon.
    Bricks settle one after the other, so ways that meet in different rounds go to the earlier.
    """
    spark = volume.sparkSession
    at = scratch(spark, "volume")
    b = lambda i, j: F.concat_ws("_", F.floor(i / brick), F.floor(j / brick))
    traces = volume.select(F.col("inl").cast("long").alias("inl"), F.col("crl").cast("long").alias("crl"), F.transform("samples", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("samples")).where("inl IS NOT NULL AND crl IS NOT NULL AND samples IS NOT NULL")
    traces = traces.groupBy("inl", "crl").agg(F.min("samples").alias("samples"))
    traces.withColumn("brick", b(F.col("inl"), F.col("crl"))).repartition("brick").write.partitionBy("brick").parquet(at)
    stored = spark.read.parquet(at) if not traces.isEmpty() else None
    window = 2 * half + 1
    calls = seeds.select(*(F.col(c).cast("long").alias(c) for c in ("inl", "crl", "z"))).where("inl IS NOT NULL AND crl IS NOT NULL AND z IS NOT NULL").distinct()
    calls = written(calls.select("inl", "crl", "z", F.lit(None).cast("long").alias("from_inl"), F.lit(None).cast("long").alias("from_crl"), F.lit(None).cast("array<double>").alias("window"), b(F.col("inl"), F.col("crl")).alias("brick")))
    nodes = spark.createDataFrame([], _NODE + ", brick string")
    schema = pa.schema([("inl", pa.int64()), ("crl", pa.int64()), ("z", pa.int64()), ("score", pa.float64()), ("from_inl", pa.int64()), ("from_crl", pa.int64()), ("window", pa.list_(pa.float64()))])

    def one(held: pa.Table, called: pa.Table) -> pa.Table:
        samples = {(i, j): np.array(s) for i, j, s, kind in zip(*(held[c].to_pylist() for c in ("inl", "crl", "samples", "z"))) if kind is None}
        tracked = {(i, j) for i, j, z in zip(*(held[c].to_pylist() for c in ("inl", "crl", "z"))) if z is not None}
        here = {(i // brick, j // brick) for i, j in samples}
        ways = []
        for i, j, z, fi, fj, w in zip(*(called[c].to_pylist() for c in ("inl", "crl", "z", "from_inl", "from_crl", "window"))):
            if (i, j) not in samples or (i, j) in tracked:
                continue
            if w is None:
                if half <= z < len(samples[i, j]) - half:
                    ways.append(((i, j), z, 1.0, (-(1 << 62), z)))
                continue
            source = np.zeros(z + half + 1)
            source[z - half :] = w
            found = best_shift(source, samples[i, j], z, half, reach)
            if found and found[0] >= least:
                ways.append(((i, j), found[1], found[0], (fi, fj)))
        new, out = _grow(samples, tracked, ways, half, reach, least, lambda n: (n[0] // brick, n[1] // brick) in here)
        rows = [(*n, None, None, None) for n in new]
        rows += [(i, j, z, None, fi, fj, samples[fi, fj][z - half : z + half + 1].tolist()) for i, j, z, fi, fj in out]
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    while stored is not None:
        active = [r.brick for r in calls.select("brick").distinct().collect()]  # names of bricks at the horizon's edge
        if not active:
            break
        near = stored.where(F.col("brick").isin(active)).select("brick", "inl", "crl", "samples", F.lit(None).cast("long").alias("z"))
        near = near.unionByName(nodes.where(F.col("brick").isin(active)).select("brick", "inl", "crl", F.lit(None).cast("array<double>").alias("samples"), "z"))
        grown = near.groupBy("brick").cogroup(calls.withColumnRenamed("brick", "of").groupBy("of")).applyInArrow(one, f"{_CALL}, window array<double>")
        grown = written(grown.withColumn("brick", b(F.col("inl"), F.col("crl"))))
        nodes = nodes.unionByName(grown.where("window IS NULL").select("inl", "crl", "z", "score", "brick"))
        asked = grown.where(F.size("window") == window).select("inl", "crl", "z", "from_inl", "from_crl", "window", "brick")
        calls = written(asked.join(nodes.select("inl", "crl"), ["inl", "crl"], "left_anti"))
        # no trace is called twice from one place: each node calls its neighbours once, when it is new
    return nodes.drop("brick")
