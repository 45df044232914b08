"""Seeds of repeated windows, which passage dedup by words and by bytes share.

Every window of `window` units lies under one anchor, its gram of least hash, and equal windows lie under equal anchors.
Rows of one anchor that agree in all they cover ("twins") are repeats as they are. Where an anchor's rows differ, one
row of each kind goes on to an exact comparison of the single windows. Only anchors are shuffled: about
2 / (window - gram + 2) rows for each unit of text. Rows of text are told apart by doc_id and tag, a hash of the text, so that null ids and
ids that come twice share nothing but equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import blocks, bloom
from terrane.llm.tables import written

#: Bytes of text in one step where units are words, and where they are bytes, each of which takes arrays of its own.
STEP_WORDS, STEP_BYTES = blocks.STEP_BYTES, 1 << 20

ANCHORS = "doc_id long, tag long, first int, count int, anchor long, around long, settled boolean, sure boolean, meet long"


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text of docs, and what other columns there are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text", *others)


def units(data: np.ndarray, offsets: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each word or byte, and where documents start among them."""
    if not by_word:
        return blocks.byte_values(data), offsets
    starts, ends, bounds = blocks.words(data, offsets)
    return blocks.Spans(blocks.byte_values(data))(starts, ends), bounds


def anchored(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, by_word: bool) -> Iterator[dict[str, np.ndarray]]:
    """blocks.anchored of a step of texts; of one text longer than a step, window by window of its parts, so that memory is
    that of a step (a row may then end where a part does: equal windows still meet at their anchor)."""
    step = STEP_WORDS if by_word else STEP_BYTES
    if len(offsets) > 2 or len(data) <= 2 * step:
        yield blocks.anchored(*units(data, offsets, by_word), window, gram)
        return
    values = units(data, offsets, True)[0] if by_word else data
    for a in range(0, len(values) - window + 1, step // 8 if by_word else step):
        part = values[a : a + (step // 8 if by_word else step) + window - 1]
        got = blocks.anchored(part if by_word else blocks.byte_values(part), np.array([0, len(part)]), window, gram)
        yield got | {"first": got["first"] + a}


def anchors(docs: DataFrame, window: int, gram: int, by_word: bool) -> DataFrame:
    """docs (doc_id, text) as rows of ANCHORS.

    Of rows that agree in anchor and around within one step of a task, the first goes on as `sure` to have a twin; the
    others are settled and meet nothing (`meet`, what rows meet by, is then no anchor but spreads them). So a passage that
    a third of all documents have comes to its anchor once for each step, not once for each document.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("anchor", pa.int64()), ("around", pa.int64()), ("settled", pa.bool_()), ("sure", pa.bool_()), ("meet", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            for i, j, data, offsets in blocks.texts(batch, limit=STEP_WORDS if by_word else STEP_BYTES):
                for got in anchored(data, offsets, window, gram, by_word):
                    n = len(got["doc"])
                    if not n:
                        continue
                    order = np.lexsort((got["around"], got["anchor"]))
                    same = np.zeros(n + 1, bool)
                    same[1:-1] = (got["anchor"][order][1:] == got["anchor"][order][:-1]) & (got["around"][order][1:] == got["around"][order][:-1])
                    settled, sure = np.empty(n, bool), np.empty(n, bool)
                    settled[order], sure[order] = same[:-1], same[1:] & ~same[:-1]
                    spread = blocks.mix(got["around"].view(np.uint64) ^ (got["doc"] << 32 | got["first"]).astype(np.uint64)).view(np.int64)
                    meet = np.where(settled, spread, got["anchor"])
                    of = pa.array(got["doc"])
                    columns = [ids.slice(i, j - i).take(of), tags.slice(i, j - i).take(of), pa.array(got["first"].astype(np.int32)), pa.array(got["count"].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in (got["anchor"], got["around"], settled, sure, meet))], schema=schema)

    return tagged(docs.select("doc_id", "text")).mapInArrow(run, ANCHORS)


def seeds(docs: DataFrame, window: int, gram: int, by_word: bool) -> DataFrame:
    """The anchors that occur more than once: twin (another row covers just the same), kind (one row of each kind that an
    anchor with several kinds has) and kinds (how many that anchor has). Written: two later steps read it."""
    by_anchor = Window.partitionBy("meet", "settled")
    inside = by_anchor.orderBy("around")
    rows = (
        anchors(docs, window, gram, by_word)
        .withColumn("before", F.lag("around").over(inside))
        .withColumn("after", F.lead("around").over(inside))
        .withColumn("new", F.col("before").isNull() | (F.col("before") != F.col("around")))
        .withColumn("twin", F.col("settled") | F.col("sure") | ~F.col("new") | F.coalesce(F.col("after") == F.col("around"), F.lit(False)))
        .where("before IS NOT NULL OR after IS NOT NULL OR twin")
        .withColumn("kinds", F.sum(F.col("new").cast("int")).over(by_anchor).cast("int"))
        .withColumn("kind", F.col("new") & ~F.col("settled") & (F.col("kinds") > 1))
        .where("twin OR kind")
    )
    return written(rows.select("doc_id", "tag", "first", "count", "anchor", "twin", "kind", "kinds"))


def with_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """rows (doc_id, tag, spans: a list of structs, bounded by the document's own length) beside the text of their document.
    Texts that rows has nothing of are not shuffled."""
    d = tagged(docs)
    r = rows.withColumnRenamed("doc_id", "of").withColumnRenamed("tag", "of_tag")
    on = d.doc_id.eqNullSafe(r.of) & (d.tag == r.of_tag)
    return bloom.beside(d, r, "xxhash64(doc_id, tag)", "xxhash64(of, of_tag)", on, how).drop("of", "of_tag")


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n units the spans (at, size) cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        at = np.minimum(np.fromiter((s["at"] for s in spans), np.int64, len(spans)), n)
        size = np.fromiter((s["size"] for s in spans), np.int64, len(spans))
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def window_hashes(docs: DataFrame, kinds: DataFrame, window: int, by_word: bool) -> DataFrame:
    """A row for each window that the rows of kinds cover: doc_id, tag, at, and 96 bits of hash (h, g)."""
    wanted = kinds.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("g", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, spans = batch.column(0), batch.column(1), batch.column(3)
            for i, j, data, offsets in blocks.texts(batch, limit=STEP_WORDS if by_word else STEP_BYTES):
                values, bounds = units(data, offsets, by_word)
                lists = spans.slice(i, j - i)
                flat = lists.flatten()
                first, count = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                of = np.repeat(np.arange(j - i), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(len(first)), count)
                at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = at + bounds[:-1][of[row]]
                inside = start + window <= bounds[1:][of[row]]
                start, at, doc = start[inside], at[inside], of[row][inside]
                h = blocks.Spans(values)(start, start + window)
                g = blocks.Spans(blocks.mix(values ^ np.uint64(0x5851F42D4C957F2D)))(start, start + window) >> np.uint64(32)
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(own), tags.slice(i, j - i).take(own), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32))], schema=schema)

    return with_text(docs.select("doc_id", "text"), wanted, "inner").mapInArrow(run, "doc_id long, tag long, at int, h long, g int")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Of window_hashes' rows, those whose hash occurs more than once: doc_id, tag, at. Hashes are counted where they are
    made before they are shuffled."""
    often = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(often, ["h", "g"]).select("doc_id", "tag", "at")


def spans_of(found: DataFrame, twins: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, spans (at, size): all that is repeated. found: starts of windows, or of spans with a size."""
    size = F.col("size") if "size" in found.columns else F.lit(window)
    both = found.select("doc_id", "tag", "at", size.alias("size")).unionByName(
        twins.select("doc_id", "tag", F.col("first").alias("at"), (F.col("count") + F.lit(window - 1)).alias("size"))
    )
    return both.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "size")).alias("spans"))
