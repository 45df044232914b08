"""Byte-level BPE by the ranks of a public vocabulary: encoding, offsets and decoding of whole columns."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import blocks
from terrane.llm.pretokens import STEP_BYTES, Cache, pieces, text_heads


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The tokens of one piece: adjacent parts whose union has the least rank, the first of them, are joined again and again."""
    if piece in rank:
        return [piece]
    if len(piece) > 64:
        return _merge_long(piece, rank)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = rank.get, len(rank) + 256
    scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while scores:
        least = min(scores)
        if least == none:
            break
        i = scores.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The same with a heap: n log n steps for a piece of n bytes."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := rank.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Each document's token ids, byte offsets of their ends, and the text that decoding the ids gives.

    Returns doc_id, ids (array of int), ends (array of long: where in the text's UTF-8 bytes each token ends) and
    decoded (binary). A null text is empty and has no ids; an empty table gives no rows; other columns are ignored;
    repeated rows are encoded each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("decoded", pa.binary())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coded(vocabulary, schema, _full), "doc_id long, ids array<int>, ends array<long>, decoded binary")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """encode's result in short: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coded(vocabulary, schema, _short), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _full(got: list[tuple], tokens: dict[int, bytes]) -> tuple:
    ids = [int(x) for _, listed, _ in got for x in listed.split(",")]
    parts = [tokens[i] for i in ids]
    return ids, np.cumsum([len(p) for p in parts], dtype=np.int64).tolist(), b"".join(parts)


def _short(got: list[tuple], tokens: dict[int, bytes]) -> tuple:
    return sum(n for n, _, _ in got), hashlib.sha256(",".join([listed for _, listed, _ in got]).encode()).hexdigest(), hashlib.sha256(b"".join([decoded for _, _, decoded in got])).hexdigest()


@functools.cache
def _coder(vocabulary: str) -> tuple[dict[int, bytes], Cache]:
    """The tokens by id, and (ids, the same in decimal, decoded bytes) of any piece; a worker keeps them from task to task."""
    rank = ranks(vocabulary)
    tokens = {r: token for token, r in rank.items()}

    def code(piece: str) -> tuple[int, str, bytes]:
        ids = [rank[part] for part in merge(piece.encode(), rank)]
        return len(ids), ",".join(map(str, ids)), b"".join([tokens[i] for i in ids])

    return tokens, Cache(code)


def _coded(vocabulary: str, schema: pa.Schema, shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, cache = _coder(vocabulary)
        for batch in batches:
            for i, j, data, offsets in blocks.texts(batch, limit=STEP_BYTES):
                heads = text_heads(data, offsets)
                found, at = pieces(data.tobytes().decode(), heads[:-1])
                got = [cache[p] for p in found]
                bounds = np.searchsorted(at, heads).tolist()
                rows = [shape(got[a:b], tokens) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return run
