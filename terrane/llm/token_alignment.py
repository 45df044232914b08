"""Cross-tokenizer alignment: each distinct segment of text is encoded and aligned once, documents are put together from them."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import blocks
from terrane.llm.pretokens import WHITE, classes_of, text_heads
from terrane.llm.tables import joined_groups, scratch, spread, written
from terrane.llm.token_counts import vocabulary

#: Bytes of text whose segments are told apart together, within a task; a longer document is a chunk of its own.
CHUNK = 1 << 25
#: What piece vocabularies write for a space.
MARK = "▁"
#: A segment of more characters goes to the slower engine, which recursion does not limit.
LONG = 1 << 16
_SEGMENTS = "chunk long, docs array<long>, sizes array<int>, codes binary, code int, segment binary, times long"
_ALIGNED = "segment binary, seg long, times long, chunks long, n_a int, n_b int, groups string, links array<long>"


@dataclass
class Pair:
    """Both tokenizers: text to ids and the bytes that each id stands for, and the white space before which texts may be cut."""

    encode_a: object
    encode_b: object
    size_a: np.ndarray
    size_b: np.ndarray
    cut: np.ndarray


@functools.cache
def pair(a: str, b: str) -> Pair:
    """The byte-level BPE tokenizer.json `a` and the sentencepiece model `b`.

    Both are looked through for what the cuts and offsets rest on, and refused without it. `a` must cut texts by the
    pattern that begins a piece at each white space behind another sign. `b` must keep texts as they are, spaces as MARK,
    and write what it has no piece for as bytes: then its tokens stand for the text's bytes unless MARK itself is in the
    text. A cut before a white space sign is safe if no piece of `b` holds that sign behind one that is not white: merges
    join neighbours to pieces only, so none reaches over such a place, and those on either side do not see each other.
    """
    import public_tokenizers
    import sentencepiece
    import tiktoken
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer

    with open(a, encoding="utf-8") as file:
        cutter = json.load(file)["pre_tokenizer"]
    if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex"):
        raise ValueError("the first tokenizer does not cut texts at white space")
    tokens, special = vocabulary(a)
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})
    slow = Tokenizer.from_file(a)
    slow.encode_special_tokens = True
    size_a = np.zeros(max([*tokens.values(), *special.values()]) + 1, np.int64)
    for token, i in tokens.items():
        size_a[i] = len(token)

    spec = sentencepiece_model_pb2.ModelProto()
    with open(b, "rb") as file:
        spec.ParseFromString(file.read())
    rules, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    n_bytes = sum(p.type == kinds.BYTE for p in spec.pieces)
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix or n_bytes != 256 or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the second tokenizer does not keep texts as they are")
    rules.add_dummy_prefix = False  # segments bring their own space
    pieces = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    size_b = np.array([1 if p.type == kinds.BYTE else len(p.piece.replace(MARK, " ").encode()) for p in spec.pieces], np.int64)
    white = np.flatnonzero(classes_of(np.arange(0x3001, dtype=np.uint32)) == WHITE)
    cut = np.zeros(0x110000, bool)
    cut[white] = True
    for p in spec.pieces:
        if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            text = np.frombuffer(p.piece.replace(MARK, " ").encode("utf-32-le"), np.uint32)
            inner = np.flatnonzero(np.isin(text[1:], white) & ~np.isin(text[:-1], white)) + 1
            cut[text[inner]] = False
    encode_a = lambda text: engine.encode_ordinary(text) if len(text) <= LONG else slow.encode(text, add_special_tokens=False).ids
    return Pair(encode_a, lambda texts: pieces.encode(texts, num_threads=1), size_a, size_b, cut)


def segments(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The segments of texts (UTF-8, each with a space put before it), and how many each text has: a text is cut where a
    run of white space begins that `cut` allows."""
    data = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(len(offsets))
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    white = classes_of(codes) == WHITE
    new = np.zeros(len(codes), bool)
    new[1:] = white[1:] & ~white[:-1] & cut[codes[1:]]
    new[text_heads(data, offsets)[:-1]] = True
    starts = heads[new]
    counts = np.diff(np.searchsorted(starts, offsets))
    at = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]), counts


def _segmented(docs: DataFrame, a: str, b: str, chunk: int) -> DataFrame:
    """Rows of two kinds: for each chunk of documents one with their ids, numbers of segments (-1: has no tokens) and
    segment codes in order; and one for each code of the chunk with the segment and its times there."""
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("code", pa.int32()), ("segment", pa.binary()), ("times", pa.int64())])

    def chunk_rows(number: int, ids: list, sizes: list, found: list) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(found, pa.large_binary()).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int32)
        times = np.bincount(codes, minlength=len(coded.dictionary))
        one = [[number], [pa.concat_arrays(ids).to_pylist()], [np.concatenate(sizes).astype(np.int32)], [pa.compress(codes.tobytes(), "zstd", asbytes=True)], [None], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, schema, strict=True)], schema=schema)
        for k in range(0, len(times), 1 << 16):
            part = coded.dictionary.slice(k, 1 << 16)
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *(pa.nulls(n, schema.field(c).type) for c in ("docs", "sizes", "codes")), pa.array(np.arange(k, k + n, dtype=np.int32)), part.cast(pa.binary()), pa.array(times[k : k + n])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cut = TaskContext.get().partitionId() << 32, pair(a, b).cut
        ids, sizes, found, held = [], [], [], 0
        for batch in batches:
            text = batch.column(1).fill_null("")
            sound = pc.and_(pc.greater(pc.binary_length(text), 0), pc.invert(pc.match_substring(text, MARK))).to_numpy(zero_copy_only=False)
            plain = pa.RecordBatch.from_arrays([text.filter(pa.array(sound))], names=["text"])
            whole, done = np.full(len(sound), -1), np.flatnonzero(sound)
            ready = 0
            for i, j, data, offsets in blocks.texts(plain, limit=min(blocks.STEP_BYTES, chunk)):
                got, counts = segments(data, offsets, cut)
                found.append(got)
                held += len(data)
                whole[done[i:j]] = counts
                if held >= chunk:
                    upto = done[j - 1] + 1
                    ids.append(batch.column(0).slice(ready, upto - ready))
                    sizes.append(whole[ready:upto])
                    yield from chunk_rows(number, ids, sizes, found)
                    ids, sizes, found, held, ready, number = [], [], [], 0, upto, number + 1
            ids.append(batch.column(0).slice(ready))
            sizes.append(whole[ready:])
        if sum(map(len, ids)):
            yield from chunk_rows(number, ids, sizes, found)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SEGMENTS)


def align_segments(texts: list[bytes], both: Pair) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Numbers of tokens of either tokenizer, groups (`a1,a2|b1;a3|b2`) and the last tokens of each group (a << 32 | b) of
    segments; how many groups each has."""
    strings = [t.decode() for t in texts]
    listed_a, listed_b = [both.encode_a(s) for s in strings], both.encode_b(strings)
    n_a, n_b = (np.array([len(x) for x in listed], np.int64) for listed in (listed_a, listed_b))
    a, b = (np.array([i for x in listed for i in x], np.int64) for listed in (listed_a, listed_b))
    end_a, end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
    stops = np.cumsum([len(t) for t in texts])
    if not (np.array_equal(end_a[np.cumsum(n_a) - 1], stops) and np.array_equal(end_b[np.cumsum(n_b) - 1], stops)):
        raise ValueError("tokens do not stand for the bytes of a segment")
    ends, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    links = a[at_a] << 32 | b[at_b]
    name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, j = [], 0, 0
    for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
        groups.append(f"{name_a[i] if x == i + 1 else ','.join(name_a[i:x])}|{name_b[j] if y == j + 1 else ','.join(name_b[j:y])}")
        i, j = x, y
    upto = np.searchsorted(ends, stops, "right")
    per = np.diff(upto, prepend=0)
    bounds = upto.tolist()
    return n_a, n_b, [";".join(groups[p:q]) for p, q in zip([0, *bounds], bounds)], links, per


def _aligned(distinct: DataFrame, a: str, b: str) -> DataFrame:
    schema = pa.schema([("segment", pa.binary()), ("seg", pa.int64()), ("times", pa.int64()), ("chunks", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = pair(a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(k, 1 << 12)
                n_a, n_b, groups, links, per = align_segments(part.column(0).to_pylist(), both)
                linked = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(links))
                number += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(number - part.num_rows, number)), part.column(1), part.column(2), pa.array(n_a.astype(np.int32)), pa.array(n_b.astype(np.int32)), pa.array(groups), linked], schema=schema)

    return distinct.mapInArrow(run, _ALIGNED)


def _scored(aligned: DataFrame) -> DataFrame:
    """(seg, n_best, count_sum): over a segment's links, how many are the most frequent with their b, and the sum of counts."""
    links = aligned.select("seg", "times", F.explode("links").alias("link"))
    counts = written(links.groupBy("link").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("segs")))
    b = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # as many rows as b has ids at most
    counts = counts.withColumn("b", b).join(F.broadcast(most), "b").select("link", "segs", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    total = counts.agg(F.sum("segs")).first()[0] or 0
    return joined_groups(links.select("seg", "link"), counts, "link", "segs", total).groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = True, chunk: int = CHUNK) -> DataFrame:
    """How the tokens of tokenizer.json `a` (of a space and the text) and of sentencepiece model `b` (which adds the space)
    lie over each other, for every whole text.

    Byte offsets where tokens of both end cut them into groups; the tokens that end there are linked. Returns doc_id, n_a,
    n_b, n_groups, n_links, n_best (links whose corpus-wide count is the highest of their b id, ties included), count_sum
    (over links, of their counts), groups_sha256 (of `a1,a2|b1;a3|b2,b3`) and with keep_groups that text itself. Texts that
    are null or empty, or that hold MARK, which `b` cannot tell from a space, have no tokens: zeros, '' and ''. Strings of
    special tokens are plain text. Texts of any length are read whole (see CHUNK; a segment, such as a text without white
    space, is encoded as a whole). Repeated rows and null ids are documents like others; an empty table gives no rows;
    other columns are ignored.

    Within a chunk of documents each distinct segment (see pair, segments) gets a code. Over the corpus each distinct
    segment is encoded and aligned once; counts of links follow from the times of segments, and go back to the segments.
    These are joined to the chunks' codes (a segment has one row for each chunk it occurs in), and each chunk puts its
    documents together. No step holds more than a chunk, and no text but segments is shuffled.
    """
    found = written(_segmented(docs, a, b, chunk))
    coded = found.where("code IS NOT NULL").select("chunk", "code", "segment", "times")
    distinct = spread(coded, "segment").groupBy("segment").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("chunks"))
    with scratch(docs.sparkSession) as outlives:
        with scratch(docs.sparkSession) as told_outlives:
            aligned = written(_aligned(distinct, a, b))
            told = told_outlives(aligned.select("seg", "segment", "chunks", "n_a", "n_b", "groups").join(_scored(aligned), "seg").drop("seg"))
            total = aligned.agg(F.sum("chunks")).first()[0] or 0
        placed = outlives(joined_groups(coded.drop("times"), told, "segment", "chunks", total).drop("segment", "chunks"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("groups_sha256", pa.string()), *([("groups", pa.string())] if keep_groups else [])])

    def compose(held: pa.Table, placed: pa.Table) -> pa.Table:
        row = held.slice(0, 1).to_pydict()
        ids, sizes = row["docs"][0], np.array(row["sizes"][0], np.int64)
        placed = placed.take(pc.sort_indices(placed, [("code", "ascending")]))
        texts = placed.column("groups").to_pylist()
        n_groups = pc.add(pc.count_substring(placed.column("groups"), ";"), 1).to_numpy().astype(np.int64)
        numbers = [placed.column("n_a").to_numpy(), placed.column("n_b").to_numpy(), n_groups, placed.column("n_best").to_numpy(), placed.column("count_sum").to_numpy()]
        total = int(np.maximum(sizes, 0).sum())
        codes = np.frombuffer(pa.decompress(row["codes"][0], 4 * total, "zstd", asbytes=True), np.int32) if total else np.zeros(0, np.int32)
        bounds = np.append(0, np.cumsum(np.maximum(sizes, 0)))
        sums = []
        for x in numbers:
            upto = np.append(0, np.cumsum(x.astype(np.int64)[codes] if total else codes.astype(np.int64)))
            sums.append(pa.array(upto[bounds[1:]] - upto[bounds[:-1]]))
        out, hashes = [], []
        for k, size in enumerate(sizes.tolist()):
            text = ";".join([texts[c] for c in codes[bounds[k] : bounds[k + 1]].tolist()]) if size > 0 else ""
            hashes.append(hashlib.sha256(text.encode()).hexdigest() if size > 0 else "")
            if keep_groups:
                out.append(text)
        columns = [pa.array(ids, pa.int64()), *sums[:3], *sums[2:], pa.array(hashes, pa.string())]
        return pa.Table.from_arrays(columns + ([pa.array(out, pa.string())] if keep_groups else []), schema=schema)

    chunks = found.where("code IS NULL").select(F.col("chunk").alias("of"), "docs", "sizes", "codes")
    kinds = f"doc_id long, {', '.join(f'{n} long' for n in names)}, groups_sha256 string{', groups string' if keep_groups else ''}"
    return chunks.groupBy("of").cogroup(placed.groupBy("chunk")).applyInArrow(compose, kinds)
