"""Periodic runs against a version that tries every start and period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from terrane.llm import blocks, periodic_runs


def plain_runs(words, least, times):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (1, 3), (9, 5)])
def test_repetitions(least, times):
    rng = random.Random(3)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 12))]
            texts.append([rng.randint(0, 3) for _ in range(rng.randint(0, 30))] + unit * rng.randint(0, 9) + unit[: rng.randint(0, 5)] + [rng.randint(0, 2) for _ in range(rng.randint(0, 40))])
        ids, bounds = np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])
        got = [tuple(r) for r in periodic_runs.repetitions(ids, bounds, least, times).tolist()]
        assert got == [(s + int(b), n, p) for t, b in zip(texts, bounds) for s, n, p in plain_runs(t, least, times)]


def test_clashing_hashes_are_found_out(monkeypatch):
    spans, made = blocks.Spans, []

    class Weak(spans):
        def __call__(self, start, end):
            return super().__call__(start, end) & np.uint64(1 if len(made) < 3 else -1 & (1 << 64) - 1)

        def __init__(self, values):
            made.append(1)
            super().__init__(values)

    monkeypatch.setattr(blocks, "Spans", Weak)
    ids = np.array([1, 2, 3] * 5 + list(range(9)) + [7] * 9)
    assert periodic_runs.repetitions(ids, np.array([0, len(ids)]), 6, 4).tolist() == [list(r) for r in plain_runs(ids.tolist(), 6, 4)]
    assert len(made) >= 3


def test_find_runs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 2)))
    texts = [None, "", " \n\t ", "one", "la " * 5, "la " * 6, "la la la la la la", "a b " * 4, "a b c " * 4 + "a", "x y " * 7]
    texts += [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(150)] + [" ".join([word() for _ in range(7)] * 6) for _ in range(10)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "b c " * 9, 2), (None, "q " * 8, 3), (5, texts[5], 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(4)
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(docs)))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert periodic_runs.find_runs(docs.where("false")).count() == 0


def test_query_over_its_whole_table(spark):
    from terrane.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(r.doc_id, r.text) for r in docs), key=repr)


def test_long_text(spark):
    unit = [f"w{k}" for k in range(997)]
    text = " ".join([*(f"x{k}" for k in range(5000)), *(unit * 500), "end", *["la"] * 400_000])
    (row,) = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(5000, 997 * 500, 997), (5001 + 997 * 500, 400_000, 1)] and tuple(row.top) == tuple(row.runs[1])
    assert row.collapsed.split() == [*(f"x{k}" for k in range(5000)), *unit, "end", "la"]
