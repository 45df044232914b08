"""Language identification by nearest centroid: TF-IDF vectors of letter n-grams, several centroids for each language."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import blocks
from terrane.llm.pretokens import LETTER, classes_of, text_heads

#: Cells that n-grams are hashed to.
CELLS = 1 << 12
#: Rows of text turned into vectors at a time; bytes of text in one step; code points counted at a time.
ROWS, STEP_BYTES, UNITS = 128, 1 << 18, 1 << 17
#: Share of a language's learned rows that each of its centroids stands for at least.
LEAST_SHARE = 0.05
#: Lengths in characters that checked texts are cut to, beside their own, to learn how near texts of a length come.
CUTS = [1 << k for k in range(2, 14)]
#: Checked texts that a floor is read from at least; languages with fewer texts than LEAST_HELD hold none back.
LEAST_CHECKED, LEAST_HELD = 50, 20


@functools.cache
def _lower() -> np.ndarray:
    return np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def counts(codes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each cell's bigrams and trigrams of letters (and gaps) occur in each text; how many letters each has.

    Code points are taken UNITS at a time, so that memory is bounded for texts of any length.
    """
    rows = len(heads) - 1
    out, letters = np.zeros(rows * CELLS, np.float32), np.zeros(rows, np.int64)
    for a in range(0, len(codes), UNITS):
        part = codes[a : a + UNITS + 2]
        n = len(part)
        doc = np.repeat(np.arange(rows), np.diff(np.clip(heads, a, a + n)))
        letter = classes_of(part) == LETTER
        letters += np.bincount(doc[:UNITS][letter[:UNITS]], minlength=rows)
        x = np.where(letter, _lower()[part], 0).astype(np.uint64)
        for size in (2, 3):
            m = min(UNITS, n - size + 1)
            if m <= 0:
                continue
            key = np.zeros(m, np.uint64)
            for k in range(size):
                key = key * np.uint64(0x9E3779B97F4A7C15) + x[k : k + m] + np.uint64(1)
            use = (doc[:m] == doc[size - 1 : size - 1 + m]) & (letter[1 : 1 + m] if size == 3 else letter[:m] | letter[1 : 1 + m])
            cell = (blocks.mix(key[use]) >> np.uint64(64 - 12)).astype(np.int64)
            found, times = np.unique(doc[:m][use] * CELLS + cell, return_counts=True)
            out[found] += times
    return out.reshape(rows, CELLS), letters


@dataclass
class Model:
    """languages: the language of each centroid; centroids: unit rows; idf; floor: least cosine that isn't rejected, at 1, 2, 4 ...
    CELLS distinct cells of a text."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf, dtype=np.float32)
        v *= self.idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return v

    def best(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.vectors(tf) @ self.centroids.T
        best = near.argmax(1)
        return best, near[np.arange(len(best)), best].astype(np.float64)

    def floors(self, tf: np.ndarray) -> np.ndarray:
        """The floor for each row, between those at the powers of two next to its distinct cells."""
        return np.interp(np.log2(np.maximum((tf > 0).sum(1), 1)), np.arange(len(self.floor)), self.floor)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, k clusters at most, of LEAST_SHARE of the rows at least.

    It starts from halves: the largest cluster is cut at the median of its main direction until there are k. A cluster
    that falls below the least size gives its rows to the others.
    """
    least = max(2, int(np.ceil(LEAST_SHARE * len(v))))
    groups = [np.arange(len(v))]
    while len(groups) < k:
        groups.sort(key=len)
        if len(groups[-1]) < 2 * least:
            break
        big = groups.pop()
        spread = v[big] - v[big].mean(0)
        main = spread[np.abs(spread).sum(1).argmax()]
        for _ in range(8):
            main = spread.T @ (spread @ main)
            main /= max(np.linalg.norm(main), 1e-12)
        order = big[np.argsort(spread @ main, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for _ in range(rounds):
        centre = np.array([v[g].sum(0) for g in groups])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        near = v @ centre.T
        sizes = np.bincount(near.argmax(1), minlength=len(groups))
        if sizes.min() < least and len(groups) > 1:
            near[:, sizes.argmin()] = -np.inf
        of = near.argmax(1)
        groups = [g for c in range(len(groups)) if len(g := np.flatnonzero(of == c))]
    centre = np.array([v[g].sum(0) for g in groups])
    return centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)


def sampled(labelled: DataFrame, per_language: int) -> tuple[dict[str, int], DataFrame]:
    """How many texts each language has, and lang, key, text of per_language different rows of each at most: those of least
    hash of doc_id and text (key), about. Copies of a row are one before the rows of a language meet."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    times = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not times:
        return times, rows.select("lang", F.lit(0).cast("long").alias("key"), "text").limit(0)
    part = F.pmod("key", F.lit(1 << 30))
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(times.items()) for x in (lang, int(min(1.0, 1.25 * per_language / n) * (1 << 30)))])
    few = rows.withColumn("key", F.xxhash64("doc_id", "text")).where(part < bound[F.col("lang")]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    return times, few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(part, "key"))).where(F.col("rank") <= per_language).drop("rank")


def fit(labelled: DataFrame, per_language: int = 600, centroids: int = 4, below: float = 0.01) -> Model:
    """A model of labelled texts (doc_id, text, lang), which holds up to `centroids` centroids for each language (see _clusters).

    It is fitted on `per_language` different rows of each language at most, those of least hash of doc_id and text, whatever
    share of the ids is null or repeated: their cell counts, at most CELLS pairs of numbers (24 KB) a row, come to the
    driver (for held-back rows also those of their cuts), where one language's rows are made dense at a time. A quarter of them is held back: the cosines of those texts, whole and cut to
    CUTS, to their nearest centroids give the floors. A text is rejected later if its cosine is below that of all but
    the share `below` of the held-back texts that have as many distinct cells (a long text that says one word again and
    again is held against short ones). A language with fewer than LEAST_HELD texts learns from and checks all of them.
    """
    times, sample = sampled(labelled, per_language)
    if not times:
        return Model([], np.zeros((0, CELLS), np.float32), np.ones(CELLS, np.float32), np.zeros(1))
    few = F.col("lang").isin([lang for lang, n in sorted(times.items()) if n < LEAST_HELD])
    held = F.pmod(F.xxhash64("key", F.lit("held back")), F.lit(4)) == 0
    # role 0: learn from; 1: check, whole or cut
    sizes = F.filter(F.array(*map(F.lit, CUTS)), lambda k: k < F.length("text"))
    parts = F.when(held | few, F.transform(F.concat(sizes, F.array(F.length("text"))), lambda k: F.struct(F.lit(1).alias("role"), k.alias("size")))).otherwise(F.array().cast("array<struct<role:int,size:int>>"))
    parts = F.concat(parts, F.when(~held | few, F.array(F.struct(F.lit(0).alias("role"), F.length("text").alias("size")))).otherwise(F.array().cast("array<struct<role:int,size:int>>")))
    sample = sample.select("text", "lang", F.explode(parts).alias("part")).select(F.col("text").substr(F.lit(1), F.col("part.size")).alias("text"), "lang", "part.role")
    schema = pa.schema([("lang", pa.string()), ("role", pa.int32()), ("cells", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tf, letters in _count_batches(batch, 0):
                keep = np.flatnonzero(letters)
                cells = [np.flatnonzero(tf[k]).astype(np.uint16) for k in keep]
                times = [tf[k][c].astype(np.float32) for k, c in zip(keep, cells, strict=True)]
                own = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(own) for c in (1, 2)), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([t.tobytes() for t in times], pa.binary())], schema=schema)

    got = sample.mapInArrow(run, "lang string, role int, cells binary, times binary").collect()
    learned, checked = ([r for r in got if r.role == k] for k in (0, 1))
    seen = np.zeros(CELLS, np.int64)
    for r in learned:
        seen[np.frombuffer(r.cells, np.uint16)] += 1
    model = Model([], np.zeros((0, CELLS), np.float32), (np.log((1 + len(learned)) / (1 + seen)) + 1).astype(np.float32), np.zeros(1))
    for lang in sorted({r.lang for r in learned}):  # one language's rows are dense at a time
        own = model.vectors(_dense([r for r in learned if r.lang == lang]))
        order = np.lexsort(own[:, :8].T)  # the same model in whatever order rows come
        centre = _clusters(own[order], centroids)
        model.languages += [lang] * len(centre)
        model.centroids = np.vstack([model.centroids, centre.astype(np.float32)])
    if model.languages and checked:
        near = [model.best(_dense(checked[k : k + ROWS]))[1] for k in range(0, len(checked), ROWS)]
        model.floor = _floor(np.array([len(r.cells) // 2 for r in checked]), np.concatenate(near), below)
    return model


def _dense(rows: list) -> np.ndarray:
    tf = np.zeros((len(rows), CELLS), np.float32)
    for row, r in zip(tf, rows, strict=True):
        row[np.frombuffer(r.cells, np.uint16)] = np.frombuffer(r.times, np.float32)
    return tf


def _floor(cells: np.ndarray, cosine: np.ndarray, below: float) -> np.ndarray:
    """The quantile `below` of the cosines at each power of two of distinct cells; where fewer than LEAST_CHECKED texts
    have about as many, what the powers next to it give."""
    steps = np.arange(int(np.log2(CELLS)) + 1)
    at = np.rint(np.log2(np.maximum(cells, 1))).astype(int)
    many = np.bincount(at, minlength=len(steps))
    known = steps[many >= min(LEAST_CHECKED, many.max())]
    return np.interp(steps, known, [np.quantile(cosine[at == k], below) for k in known])


def _count_batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first in range(0, batch.num_rows, ROWS):
        part = batch.slice(first, ROWS)
        for i, j, data, offsets in blocks.texts(part, part.schema.names[column], STEP_BYTES):
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            yield first + i, first + j, *counts(codes, text_heads(data, offsets))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected of every whole text; with `keep`,
    those columns of docs in place of doc_id.

    A text that is null or has no letters is `und` with score 0, and rejected. Others get the language of the nearest
    centroid; they are rejected if they are further from it than the floor at their distinct cells allows. Ties go to the
    centroid that comes first by language. Texts of any length are read whole, in pieces of bounded size. Repeated rows
    and null ids are rows like others; an empty table gives no rows; a model fitted on no rows calls everything `und`;
    other columns are ignored.
    """
    names = keep or ["doc_id"]
    rows = docs.select(*names, F.col("text").alias("text to read")) if keep else docs.select(F.col("doc_id").cast("long"), F.col("text").alias("text to read"))
    found = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tf, letters in _count_batches(batch, len(names)):
                known = letters > 0 if model.languages else np.zeros(j - i, bool)
                best, cosine = model.best(tf) if model.languages else (np.zeros(j - i, np.int64), np.zeros(j - i))
                langs = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                floor = model.floors(tf) if model.languages else 1.0
                score = np.where(known, np.clip(cosine, 0, 1), 0.0)
                columns = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(score), pa.array(~known | (score < floor))], schema=pa.schema([*list(batch.schema)[:-1], *found]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
