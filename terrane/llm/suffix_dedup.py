"""Suffix-array dedup: byte strings that occur twice, found by two-stage suffix sorting, are cut out of every text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import blocks
from terrane.llm.repeats import covered, repeated_windows, seeds, spans_of, window_hashes, with_text
from terrane.llm.tables import scratch, spread

#: Ends a segment in a sorted text; UTF-8 never has this byte.
END = 255
#: Bytes of segments that are sorted at a time; anchor groups stay whole.
SORT_BYTES = 1 << 20
#: Kinds of one anchor beyond which its windows are compared by hash, each a row of its own, so that no group is held.
CROWD = 4096

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _eights(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as numbers that compare as they do. text has eight more bytes than places."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(">u8").ravel().astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last one is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    after = np.searchsorted(change, np.arange(n))
    rises = np.append(text[change + 1] > text[change], False)
    return rises[after]


def sort_directly(text: np.ndarray, at: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Suffixes `at` by their first `need[at]` bytes at least; only ties are read further, eight bytes at a time."""
    padded = np.append(text, np.zeros(int(need.max(initial=0)) + 16, np.uint8))
    key = _eights(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(at) else np.zeros(0, np.int64)
    slots, depth = np.arange(len(at)), 8
    while len(slots):
        tied = np.zeros(len(slots), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= need[at[slots]] > depth
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        here = at[slots]
        key = _eights(padded, here + depth)
        order = np.lexsort((key, group))
        at[slots] = here[order]
        key, group = key[order], group[order]
        group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        depth += 8
    return at


def suffix_array(text: np.ndarray, need: np.ndarray) -> np.ndarray:
    """All suffixes of text in order of their first `need` bytes (need[i + 1] >= need[i] - 1).

    First stage: only suffixes smaller than their successors are sorted. Second stage: buckets by first byte are scanned
    upwards; each suffix met places its predecessor, if that is the larger, next in the bucket of its own first byte.
    """
    n = len(text)
    direct = sort_directly(text, np.flatnonzero(smaller_than_next(text)), need)
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        bucket = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            bucket.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
        full = np.concatenate([*bucket, direct[edges[c] : edges[c + 1]]])
        out.append(full)
        before = full[full > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else []
        for part in np.split(before, cut[1:]) if len(byte) else []:
            waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, `most` at the most, each pair of suffixes has in common (in steps of eight, but for `most` itself)."""
    padded = np.append(text, np.zeros(most + 16, np.uint8))
    got, live = np.zeros(len(left), np.int64), np.arange(len(left))
    for depth in range(0, most - most % 8, 8):
        live = live[_eights(padded, left[live] + depth) == _eights(padded, right[live] + depth)]
        got[live] += 8
    rest = most % 8
    if rest and len(live):
        shift = np.uint64(8 * (8 - rest))
        live = live[_eights(padded, left[live] + most - rest) >> shift == _eights(padded, right[live] + most - rest) >> shift]
        got[live] = most
    return got


def repeated_in(bodies: list[np.ndarray], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of each of the first `counts` windows of the segments that occurs in another place too."""
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1)
    text = np.concatenate([x for b in bodies for x in (b, np.array([END], np.uint8))])
    segment = np.repeat(np.arange(len(bodies)), sizes + 1)
    place = np.arange(len(text)) - (ends - sizes - 1)[segment]
    left = sizes[segment] - place + 1
    order = suffix_array(text, np.minimum(left, window))
    order = order[place[order] < counts[segment[order]]]
    same = common_prefixes(text, order[:-1], order[1:], window) >= window
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    found = order[hit]
    return segment[found], place[found]


def _segments(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """The bytes that each row of kinds covers: anchor, doc_id, tag, first, count, body."""
    wanted = kinds.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "first", "count")).alias("spans"))
    parts = with_text(docs.select("doc_id", "text"), wanted, "inner").select("doc_id", "tag", F.encode("text", "UTF-8").alias("bytes"), F.explode("spans").alias("s"))
    return parts.select("s.anchor", "doc_id", "tag", "s.first", "s.count", F.substring(F.col("bytes"), F.col("s.first") + 1, F.col("s.count") + F.lit(window - 1)).alias("body"))


def _sorted_repeats(segments: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, at of the repeated windows of the segments, which meet by anchor."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        body = rows["body"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)
        segment, place = repeated_in([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], rows["count"].to_numpy(), window)
        at = rows["first"].to_numpy()[segment] + place
        own = pa.array(segment)
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(own) for c in ("doc_id", "tag")), pa.array(at.astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            anchor, body = batch.column(0).to_numpy(), pc.binary_length(batch.column(5)).to_numpy()
            begin, done = 0, np.cumsum(body)
            for cut in (np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist() + [len(anchor)] if len(anchor) else []:
                fresh = begin == 0 and held and held[-1]["anchor"][-1].as_py() != anchor[0]
                grown = size + int(done[cut - 1]) - (int(done[begin - 1]) if begin else 0)
                if (fresh and size >= SORT_BYTES) or (cut < len(anchor) and grown >= SORT_BYTES):
                    if fresh and size >= SORT_BYTES:
                        yield solve(pa.concat_tables(held))
                        held, size = [], 0
                        grown = int(done[cut - 1])
                    if cut < len(anchor) and grown >= SORT_BYTES:
                        held.append(pa.Table.from_batches([batch.slice(begin, cut - begin)]))
                        yield solve(pa.concat_tables(held))
                        held, size, begin = [], 0, cut
            if begin < len(anchor):
                held.append(pa.Table.from_batches([batch.slice(begin)]))
                size += int(done[-1]) - (int(done[begin - 1]) if begin else 0)
        if held:
            yield solve(pa.concat_tables(held))

    return spread(segments, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, tag long, at int")


def remove_repeats(docs: DataFrame, min_bytes: int = 200, gram: int = 72, keep_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Each document without the bytes that lie in a string of `min_bytes` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross documents, may overlap, may lie in one document, and are judged on the
    input. Strings meet by their anchor (the `gram` bytes of least hash in them). Where the rows of an anchor differ,
    their bytes are put in one text whose suffix array is built by two-stage sorting; neighbours in it with a common
    prefix of min_bytes bytes are repeats.

    Returns one row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text
    (null unless keep_text; a character that loses only some of its bytes is left out of it), and the columns of
    docs that `keep` names. A null text is empty. Null ids and repeated rows are documents like others: rows are told
    apart by doc_id and a 64-bit hash of the text. An empty table gives no rows; other columns are ignored.
    """
    names = keep or []
    with scratch(docs.sparkSession) as outlives:
        found = seeds(docs, min_bytes, gram, False)
        kinds = found.where("kind")
        sorted_ = _sorted_repeats(_segments(docs, kinds.where(F.col("kinds") <= CROWD), min_bytes), min_bytes)
        crowded = repeated_windows(window_hashes(docs, kinds.where(F.col("kinds") > CROWD), min_bytes, False))
        spans = outlives(spans_of(sorted_.unionByName(crowded), found.where("twin"), min_bytes))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, marks in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                kept = text.as_py() or b""
                n, runs = len(kept), 0
                if marks.is_valid and n:
                    gone = covered(marks.as_py(), n)
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(kept, np.uint8)[~gone].tobytes()
                rows.append((doc_id, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep_text else None))
            columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema]
            named = [batch.schema.get_field_index(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(k) for k in named)], schema=pa.schema([*schema, *(batch.schema.field(k) for k in named)]))

    beside = with_text(docs.select("doc_id", "text", *(c for c in names if c != "text")), spans, "left")
    kinds_of = "".join(f", `{c}` {beside.schema[c].dataType.simpleString()}" for c in names)
    return beside.mapInArrow(cut, SCHEMA + kinds_of)
