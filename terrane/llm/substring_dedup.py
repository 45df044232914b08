"""Substring dedup by seed and extend: word passages that occur twice are cut out of every text that has them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import blocks
from terrane.llm.repeats import covered, repeated_windows, seeds, spans_of, units, window_hashes, with_text
from terrane.llm.tables import scratch, spread

#: Rows that are extended at a time; the rows of one anchor stay together.
ROWS = 1 << 14
#: Kinds of one anchor beyond which its matches are extended by hash, one window a row, so that no task holds the group.
CROWD = 4096

SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _seed_rows(docs: DataFrame, kinds: DataFrame, window: int, gram: int) -> DataFrame:
    """Each row of kinds with the words it covers, as 64-bit values, and with where the anchor lies among them."""
    wanted = kinds.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count", "anchor")).alias("spans"))
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("place", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks.texts(batch):
                values, bounds = units(data, offsets, True)
                lists = batch.column(3).slice(i, j - i)
                first, count, anchor = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                doc = np.repeat(np.arange(j - i), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                start = first + bounds[:-1][doc]
                place, span = np.full(len(first), -1), blocks.Spans(values)
                for k in range(window - gram, -1, -1):  # the leftmost gram that all windows of the row have
                    at = np.minimum(start + k, len(values) - gram)
                    place[(k >= count - 1) & (span(at, at + gram).view(np.int64) == anchor)] = k
                raw = values.tobytes()
                words = [raw[8 * a : 8 * b] for a, b in zip(start.tolist(), (start + count - 1 + window).tolist(), strict=True)]
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *(batch.column(c).slice(i, j - i).take(own) for c in (0, 1)), *(pa.array(x.astype(np.int32)) for x in (first, count, place)), pa.array(words, pa.binary())], schema=schema)

    return with_text(docs.select("doc_id", "text"), wanted, "inner").mapInArrow(run, "anchor long, doc_id long, tag long, first int, count int, place int, words binary")


def extended(seed: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """For each k, which matches stay together with another one when they reach k words to the left and as many to the
    right as make a window.

    seed: the anchor of each match, as a number; left and right: the words beside the anchor, nearest first, as numbers
    from 1, 0 where a row has none (it goes no further then). Matches of one anchor start as one class; each word to one side splits classes, and a window is
    repeated if some other match is in its class on both sides.
    """
    n, most = left.shape

    def classes(words: np.ndarray) -> list[np.ndarray]:
        got, many = [seed], int(words.max(initial=0)) + 1
        for k in range(most):
            last, out = got[-1], np.full(n, -1)
            on = np.flatnonzero((last >= 0) & (words[:, k] > 0))
            _, out[on] = np.unique(last[on] * many + words[on, k], return_inverse=True)
            got.append(out)
        return got

    before, behind, found = classes(left), classes(right), []
    for k in range(most + 1):
        a, b = before[k], behind[most - k]
        on = np.flatnonzero((a >= 0) & (b >= 0))
        _, which, times = np.unique(a[on] * (n + 1) + b[on], return_inverse=True, return_counts=True)
        hit = np.zeros(n, bool)
        hit[on] = times[which] > 1
        found.append(hit)
    return found


def _extend(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """_seed_rows, met by anchor, as maximal repeats: doc_id, tag, at, size."""
    most = window - gram
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])

    def solve(table: pa.Table) -> pa.RecordBatch:
        first, count, place = (table[c].to_numpy().astype(np.int64) for c in ("first", "count", "place"))
        n = len(first)
        _, seed = np.unique(table["anchor"].to_numpy(), return_inverse=True)
        body = table["words"].combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + n + 1] // 8
        _, word = np.unique(np.frombuffer(body.buffers()[2], np.uint64, ends[-1]), return_inverse=True)
        word = np.append(word + 1, 0)
        step = np.arange(most)
        at = ends[:-1, None] + place[:, None] - 1 - step
        left = word[np.where(at >= ends[:-1, None], at, len(word) - 1)]
        at = ends[:-1, None] + place[:, None] + gram + step
        right = word[np.where(at < ends[1:, None], at, len(word) - 1)]
        hits = np.zeros((n, most + 2), bool)  # by row and window
        for k, hit in enumerate(extended(seed, left, right)):
            j = place - k
            on = np.flatnonzero(hit & (j >= 0) & (j < count))
            hits[on, j[on]] = True
        edge = np.diff(np.pad(hits, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        own = pa.array(row)
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(own) for c in ("doc_id", "tag")), pa.array((first[row] + begin).astype(np.int32)), pa.array((end - begin + window - 1).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for rows in blocks.groups(batches, "anchor"):
            if many and many + len(rows) > ROWS:
                yield solve(pa.concat_tables(held).combine_chunks())
                held, many = [], 0
            held.append(rows)
            many += len(rows)
        if held:
            yield solve(pa.concat_tables(held).combine_chunks())

    return spread(rows, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, tag long, at int, size int")


def remove_repeats(docs: DataFrame, min_words: int = 35, gram: int = 12, keep_text: bool = True) -> DataFrame:
    """Each document without the words that lie in a run of `min_words` words that also starts anywhere else.

    Words are maximal runs of anything but ASCII white space, compared by 64-bit hashes. Documents are joined on winnowed
    anchors (the `gram`-word hash that is least in a run of min_words words). Matches of an anchor are extended word by
    word both ways (see extended), and windows that still match are put together to maximal repeats of at least
    min_words words. Rows that agree in all that an anchor can cover, as exact copies do, are settled before as one kind;
    anchors with over CROWD kinds are extended by hash, window by window. Runs are judged on the input, and overlapping
    ones count.

    Returns one row for each row: doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_sha256 (of the kept
    words joined by one space) and kept_text (null unless keep_text). A null text is empty. Null ids and repeated rows
    are documents like others: rows are told apart by doc_id and a 64-bit hash of the text. An empty table gives no
    rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as outlives:
        found = seeds(docs, min_words, gram, True)
        kinds = found.where("kind")
        extended_ = _extend(_seed_rows(docs, kinds.where(F.col("kinds") <= CROWD), min_words, gram), min_words, gram)
        crowded = repeated_windows(window_hashes(docs, kinds.where(F.col("kinds") > CROWD), min_words, True))
        spans = outlives(spans_of(extended_.unionByName(crowded.withColumn("size", F.lit(min_words))), found.where("twin"), min_words))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, marks in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = (text.as_py() or b"").split()
                n = len(words)
                gone = covered(marks.as_py(), n) if marks.is_valid else None
                runs = 0
                if gone is not None:
                    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((doc_id, n, n - len(words), runs, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return with_text(docs.select("doc_id", "text"), spans, "left").mapInArrow(cut, SCHEMA)
