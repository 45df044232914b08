"""Periodic runs of words: divide and conquer after Main and Lorentz, level by level over the middles of all blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import blocks

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_KIND = "struct<start:bigint,length:bigint,period:bigint>"


def interned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """An id for each word, equal for equal words; where each text's words begin (one more entry than texts); words by id."""
    starts, ends, bounds = blocks.words(data, offsets)
    letters, at = data[~blocks.SPACE[data]], np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), bounds, words.dictionary.to_pylist()


def z_values(span: blocks.Spans, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How far, up to limit, the sequence from a on equals that from b on; with `back`, what ends before a and before b."""
    reach = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
    while step:
        able = np.flatnonzero(reach + step <= limit)
        x, y, done = a[able], b[able], reach[able]
        same = span(x - done - step, x - done) == span(y - done - step, y - done) if back else span(x + done, x + done + step) == span(y + done, y + done + step)
        reach[able[same]] += step
        step >>= 1
    return reach


def _distinct(found: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start; of those with one start and length, the least period."""
    found = found[np.lexsort(found.T[::-1])]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def repetitions(ids: np.ndarray, bounds: np.ndarray, least: int, times: int) -> np.ndarray:
    """All maximal runs (start, length, period: the smallest) of max(least, times * period) units at least, within texts.

    At level k each text is cut into blocks of 2 * 2^k units. A run that lies in one block and holds both units beside its
    middle repeats there what lies a period before, or behind: for every period up to 2^k * 2 / times, the Z-values of the
    middle forwards and backwards say how long. They are found by halving over prefix hashes, for all middles at once, of
    those periods whose next unit agrees; so long texts of one period take n log² n steps. A run is found in the block
    where its two halves part, so extension beyond the block only finds it again; intervals are told apart at the end. Runs
    are compared unit by unit at last: if hashes ever clash, all is done again with other hashes.
    """
    for seed in range(64):
        found = _repetitions(ids, bounds, least, times, seed)
        if all(np.array_equal(ids[s : s + n - p], ids[s + p : s + n]) for s, n, p in found.tolist()):
            return found
    raise ValueError("hashes of different words clash again and again")


def _repetitions(ids: np.ndarray, bounds: np.ndarray, least: int, times: int, seed: int) -> np.ndarray:
    span = blocks.Spans(blocks.mix(ids.astype(np.uint64) + np.uint64((seed << 40) + 1)))
    sizes, out = np.diff(bounds), [np.zeros((0, 3), np.int64)]
    half = 1
    while half < sizes.max(initial=0):
        most = min(half * 2 // times, half)
        if 2 * half >= least and most:
            many = np.where(sizes > half, (sizes - half - 1) // (2 * half) + 1, 0)
            text = np.repeat(np.arange(len(sizes)), many)
            middle = bounds[text] + half + 2 * half * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
            # middles in slices, so that memory follows the texts and not their number times the periods
            for cut in range(0, len(middle), max(1, (1 << 20) // most)):
                part = slice(cut, cut + max(1, (1 << 20) // most))
                out.append(_crossing(ids, span, middle[part], bounds[text[part]], bounds[text[part] + 1], most, least, times))
        half *= 2
    return _distinct(np.concatenate(out))


def _crossing(ids: np.ndarray, span: blocks.Spans, middle: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int, least: int, times: int) -> np.ndarray:
    period = np.tile(np.arange(1, most + 1), len(middle))
    own = np.repeat(np.arange(len(middle)), most)
    found = []
    for a, b in ((middle[own] - period, middle[own]), (middle[own], middle[own] + period)):
        inside = np.flatnonzero((a >= begin[own]) & (b < end[own]))
        inside = inside[ids[a[inside]] == ids[b[inside]]]
        a, b, p = a[inside], b[inside], period[inside]
        forth = z_values(span, a, b, end[own[inside]] - b, False)
        back = z_values(span, a, b, a - begin[own[inside]], True)
        length = forth + back + p
        long = length >= np.maximum(least, times * p)
        found.append(np.stack([(a - back)[long], length[long], p[long]], 1))
    return _distinct(np.concatenate(found))


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """The runs of every whole text and the text without their repeats.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical), of max(least, times * q)
    words at least, that no neighbour extends; times is 2 or more. Returns doc_id, n_words, runs (array of start, length,
    period, by start and then period), top (the run of greatest length / period; ties: smallest start, then period; null
    without runs) and collapsed (the words joined by one space, without those that a run contains after its first q). A
    null, empty or white text has no words, no runs and an empty collapsed text. Words are what ASCII white space parts, as
    they are. Texts of any length are worked on whole, in memory of about 200 bytes a word. Null and repeated ids are rows
    like others; an empty table gives no rows; other columns are ignored.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("top", _RUNS.value_type), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks.texts(batch):
                ids, bounds, words = interned(data, offsets)
                found = repetitions(ids, bounds, least, times)
                depth = np.zeros(len(ids) + 1, np.int64)
                np.add.at(depth, found[:, 0] + found[:, 2], 1)
                np.add.at(depth, found[:, 0] + found[:, 1], -1)
                keep = np.cumsum(depth[:-1]) == 0
                at = np.searchsorted(found[:, 0], bounds)
                rows = []
                for k in range(j - i):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    own = [{"start": s - a, "length": n, "period": p} for s, n, p in found[at[k] : at[k + 1]].tolist()]
                    kept = ids[a:b] if not own else ids[a:b][keep[a:b]]
                    rows.append((b - a, own, _top(own), b" ".join([words[x] for x in kept.tolist()])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs array<{_KIND}>, top {_KIND}, collapsed string")


def _top(runs: list[dict]) -> dict | None:
    best = None
    for r in runs:
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    return best


def digests(found: DataFrame) -> DataFrame:
    """find_runs' result in short."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts repeats a part of its own to the end: with h = crc32 of the decimal id,
    g = floor(h / 10) and n words, if h % 10 = 0 each word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Texts without an id or words stay as they are."""
    h: Column = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    drawn = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (F.col("text").isNotNull() & F.coalesce(h % 10 == 0, F.lit(False))).alias("chosen"))
    drawn = drawn.withColumn("words", F.when(F.col("chosen"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    drawn = drawn.withColumn("n", F.size("words"))
    drawn = drawn.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    drawn = drawn.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, "p"), F.ceil(rest / F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.slice("words", F.lit(1), "a"), F.slice(again, F.lit(1), rest))
    return drawn.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))
