"""Exact top-k search by vector-approximation files: cells of one byte bound every score, few vectors are then read whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.tables import written

#: Components of the queries, and of the candidates, that meet in one task.
QUERY_CELLS, CANDIDATE_CELLS = 1 << 20, 1 << 22
#: Bounds that are computed at a time.
_STEP = 1 << 22


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x: floor(scale * component), computed as doubles. Vectors that are null or hold null or non-finite
    components are left out."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")
    )


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a list column's rows, and all their values."""
    lists = column.combine_chunks()
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _matrix(size: np.ndarray, values: np.ndarray, width: int, kind) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    out = np.zeros((len(size), width), kind)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = values
    return out


def approximated(rows: DataFrame) -> DataFrame:
    """rows (row, vec_id, x) as the approximation file: row, vec_id, shift, and cells, a byte for each component.

    A component lies from cell << shift up to ((cell + 1) << shift) - 1; shift is the least at which all cells of the
    vector are bytes.
    """
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("shift", pa.int32()), ("cells", pa.binary())])

    def run(batches):
        for batch in batches:
            size, x = _lists(pa.chunked_array([batch.column(2)]))
            most = np.zeros(len(size), np.int64)
            np.maximum.at(most, np.repeat(np.arange(len(size)), size), np.where(x < 0, ~x, x))
            shift = np.zeros(len(size), np.int64)
            while (over := most >> shift > 127).any():
                shift[over] += 1
            cells = (x >> np.repeat(shift, size)).astype(np.int8).tobytes()
            ends = np.cumsum(size)
            cells = [cells[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shift.astype(np.int32)), pa.array(cells, pa.binary())], schema=schema)

    return rows.select("row", "vec_id", "x").mapInArrow(run, "row long, vec_id long, shift int, cells binary")


def bounds(q: np.ndarray, q_id: np.ndarray, cells: np.ndarray, shift: np.ndarray, x_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of cells, least score, greatest score) for each query: those that can be among its k best, but for its own id.

    The kth greatest of the least scores sets aside all whose greatest score is below it.
    """
    unit = (1 << shift).astype(np.float64)
    wide, out, step = cells.astype(np.float64).T, [], max(1, _STEP // max(1, len(cells)))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        base = (part @ wide) * unit
        for row, up, down, own in zip(base, np.maximum(part, 0).sum(1), np.minimum(part, 0).sum(1), q_id[i : i + step], strict=True):
            low = np.where(x_id == own, -np.inf, row + (unit - 1) * down)
            high = row + (unit - 1) * up
            live = low > -np.inf
            if live.sum() > k:
                live &= high >= np.partition(low, len(low) - k)[len(low) - k]
            live = np.flatnonzero(live)
            out.append((live, low[live], high[live]))
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, the k others of greatest inner product.

    Scores are inner products of floor(scale * x), exact as long as they and their bounds stay below 2^53; ties go to the
    smaller vec_id. Queries meet the approximation file (a byte a component) block by block, each pair of blocks a task of
    bounded size; a candidate leaves it with bounds of its score if it can be among the k best of the block. The kth
    greatest lower bound over all blocks then sets aside all but few candidates, whose vectors alone are read whole and
    scored exactly. Shorter vectors count as filled up with zeros. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; a row with the query's own id is no candidate; repeated ids are
    candidates each, and, as queries, ask once for each row that differs. An empty table gives no rows; other columns are ignored.
    """
    rows = written(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    queries = rows.where(is_query).groupBy("vec_id", "x").agg(F.min("row").alias("row"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.count(F.when(is_query, 1)).alias("q")).first()
    width = max(1, size.width or 1)
    blocks_q, blocks_c = (max(1, -(-n * width // cells)) for n, cells in ((size.q, QUERY_CELLS), (size.n, CANDIDATE_CELLS)))

    def spread(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    q = spread(queries.select("row", "vec_id", "x"), "bq", blocks_q, "bc", blocks_c)
    c = spread(approximated(rows), "bc", blocks_c, "bq", blocks_q)
    schema = pa.schema([("asked", pa.int64()), ("row", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        cells = right["cells"].combine_chunks()
        sizes = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1])
        flat = np.frombuffer(b"".join(cells.to_pylist()), np.int8)
        found = bounds(_matrix(*_lists(left["x"]), width, np.float64), left["vec_id"].to_numpy(), _matrix(sizes, flat, width, np.int8), right["shift"].to_numpy(), right["vec_id"].to_numpy(), k)
        many = [len(f[0]) for f in found]
        at, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_arrays([pa.array(np.repeat(left["row"].to_numpy(), many)), pa.array(right["row"].to_numpy()[at]), pa.array(low), pa.array(high)], schema=schema)

    met = written(q.groupBy("bq", "bc").cogroup(c.groupBy("bq", "bc")).applyInArrow(meet, "asked long, row long, low double, high double"))
    nth = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("low")))
    least = met.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("asked").agg(F.when(F.max("nth") == k, F.min("low")).otherwise(float("-inf")).alias("least"))
    left_over = met.join(least, "asked").where("high >= least").select("asked", "row")
    asked = queries.select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("x").alias("y"))
    read = left_over.join(rows.select("row", "vec_id", "x"), "row").join(asked, "asked")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    scored = read.select("asked", "query_id", "vec_id", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
