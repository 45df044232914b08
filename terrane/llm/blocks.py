"""Array helpers the text operators share: Arrow batches seen as one byte array, span hashes, window anchors."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; a longer document makes one longer step.
STEP_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
#: Bits of a packed (hash, position) that hold the position.
_PLACE = 28
#: What a word is not made of: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def texts(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    give_back()


@functools.cache
def _trim():
    """The C library's own way to give memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Memory that a batch has used and let go, to the system: workers live on, and stages that follow need it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, STEP_BYTES + (1 << 17)), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of any spans of a sequence of 64-bit values, equal for equal spans wherever they lie."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, _INVERSE)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it (one more entry than documents)."""
    gap = SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = ~gap[inner]
    last[inner - 1] = ~gap[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i that has as many."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def anchored(values: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Windows of `window` units, gathered by the gram of least hash in them, their anchor.

    values: a 64-bit value for each unit; bounds: where documents start, and the end. Equal windows have equal anchors
    at equal places, so they meet under one anchor hash. Successive windows with one anchor make one row: doc (index),
    first (window start, from the document's start), count (of windows), anchor (hash of the gram), around (hash of all
    that the row's windows cover, and of where the anchor lies in it).
    """
    width, n = window - gram + 1, len(values)
    if n > 1 << _PLACE:
        raise ValueError(f"a text of over {1 << _PLACE} units is too long to be anchored")
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("doc", "first", "count", "anchor", "around", "start")}
    span = Spans(values)
    at = np.arange(n - gram + 1)
    grams = span(at, at + gram)
    place = np.uint64((1 << _PLACE) - 1)
    owner = (sliding_min((grams & ~place) | at.astype(np.uint64), width) & place).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - window + 1, 0))
    sizes = np.maximum(np.diff(bounds) - window + 1, 0)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[:-1][doc]
    own = owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    first = starts[head]
    around = mix(span(first, first + count - 1 + window) + (own[head] - first).astype(np.uint64))
    return {"doc": doc[head], "first": first - bounds[doc[head]], "count": count, "anchor": grams[own[head]].view(np.int64), "around": around.view(np.int64), "start": first}


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
