"""Packing by best-fit decreasing into windows of a fixed length, planned on the counts of lengths."""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import blocks
from terrane.llm.pretokens import STEP_BYTES, Cache, pieces
from terrane.llm.tables import written
from terrane.llm.token_counts import encoder, vocabulary

#: Pieces of one length are numbered in parts of about so many rows, so that a length that many documents share is no
#: single task; and in so many parts at least.
PART_ROWS, PARTS = 1 << 16, 64
#: Bytes of the longest text that is encoded as a whole.
WHOLE = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Capacities:
    """A segment tree over remaining capacities: the tightest that still holds a given length, in log n steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where pieces go, the longest first, each in the tightest open window: (length, first rank, first window, offset);
    and the number of windows.

    The piece of a length with rank first rank + k goes to window first window + k, up to the next entry of the length.
    Pieces of one length are alike and so are windows filled alike: they are placed by the group, and the work depends
    on the number of different lengths only.
    """
    tree, groups, plan, opened = Capacities(window), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = window
                each = room // length
                base, n = opened, -(-left // each)
                opened += n
            else:
                base, n = groups[room].pop()
                tree.add(room, -n)
                each = room // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
                rest = rest if rest < each else 0
            for start, many, slots in ((base, full, each), (base + full, 1 if rest else 0, rest)):
                if many:
                    for slot in range(slots):
                        plan.append((length, rank, start, window - room + slot * length))
                        rank += many
                    left -= many * slots
                    if room - slots * length:
                        groups[room - slots * length].append((start, many))
                        tree.add(room - slots * length, many)
            used = full + (1 if rest else 0)
            if used < n:
                groups[room].append((base + used, n - used))
                tree.add(room, n - used)
    return plan, opened


@functools.cache
def _coder(tokenizer: str):
    """The ids of a UTF-8 text, as bytes: whole texts by the engine that token counts use, whose ids are those of the
    tokenizers library (tests hold both against each other); texts over WHOLE bytes piece by piece, which takes white
    space of any length."""
    special = {text: np.uint32(i).tobytes() for text, i in vocabulary(tokenizer)[1].items()}
    encode, _, merge = encoder(tokenizer)
    cache = Cache(lambda piece: special.get(piece) or array("I", merge(piece)).tobytes())

    def code(data: bytes) -> bytes:
        text = data.decode()
        if len(data) <= WHOLE:
            return array("I", encode(text)).tobytes()
        found, _ = pieces(text, np.zeros(1, np.int64), _spans(text, special))
        return b"".join([cache[p] for p in found])

    return code


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Each document's ids, end_id last, cut into full windows and a rest: PIECES."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(tokenizer)
        last = np.uint32(end_id).tobytes()
        for batch in batches:
            for i, j, data, offsets in blocks.texts(batch, limit=STEP_BYTES):
                rows, raw = [], data.tobytes()
                for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    ids = code(raw[a:b]) + last
                    for k in range(0, len(ids), 4 * window):
                        part = ids[k : k + 4 * window]
                        rows.append((doc, k // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
                doc, *rest = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(doc), *rest], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _spans(text: str, special: dict[str, bytes]) -> list[tuple[int, int]]:
    """Where special strings stand."""
    out = []
    for token in special:
        at = text.find(token)
        while at >= 0:
            out.append((at, at + len(token)))
            at = text.find(token, at + len(token))
    return sorted(out)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Every document's tokens in windows of `window`: a row for each piece, with its sequence_id and offset there.

    Documents (ids of the tokenizer, then end_id) longer than a window are first cut into full windows, which are
    sequences of their own; the rests and the shorter ones are placed by best-fit decreasing over all documents. The plan
    is made on how many pieces have each length, less than `window` numbers; pieces of one length are then numbered in
    parts, whose number grows with the input, and each looks up its place. Sequence ids of the plan are dense from 0,
    those of full windows come behind them.

    A null or empty text is the end_id alone; rows are documents even if they repeat or have no id; pieces that tie in
    length, doc_id, start and ids may swap places; an empty table gives no rows; other columns are ignored. Returns
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    found = written(token_pieces(docs, tokenizer, end_id, window))
    rests = found.where(F.col("length") < window)
    counts = {r.length: r.n for r in rests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, opened = best_fit(counts, window)
    full = found.where(F.col("length") == window).select("*", (F.monotonically_increasing_id() + opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = defaultdict(list)
    for length, rank, sequence, offset in plan:
        places[length].append((rank, sequence, offset))
    places = {k: np.array(v, np.int64).T for k, v in places.items()}
    parts = max(PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    rests = rests.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = rests.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = rests.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                first, base, at = places[size]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*columns[:5], "sequence_id", "offset"])

    return ranked.select(*columns).mapInArrow(place, f"{PIECES}, sequence_id long, offset long").unionByName(full)
