"""Exact dedup against a plain version: ties, repeated rows, null ids, hot groups, a crowded filter."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrane.llm import bloom, exact_dedup, tables

TEXTS = [None, "", " \n", "a b", "ab", "a  b", "c", "ç", "ç", "\x0bab\x0c", "a b", "日本 語", "日本語", "x" * 300_000, "x " * 300_000, "alone"] + ["hot copy"] * 60
ROWS = [(k if k % 7 else None, t, k) for k, t in enumerate(TEXTS)] + [(4, "ab", 0), (4, "ab", 1), (3, "a b", 5)]


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for normal, members in groups.items():
        members.sort()
        sha = hashlib.sha256(normal.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [exact_dedup.WORDS, 8, 1])
@pytest.mark.parametrize("hot", [1000, 2])
def test_mark(spark, monkeypatch, words, hot):
    monkeypatch.setattr(tables, "HOT_PARTS", hot)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, sha int").withColumn("row", F.lit(1)).repartition(5)
    got = exact_dedup.mark(docs, ["sha", "row"], words)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "sha", "row"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == plain(ROWS)
    assert exact_dedup.mark(docs.where("false")).count() == 0
    left = exact_dedup.deduplicate(docs, ["text"], words)
    assert sorted(re.sub(r"\s", "", r.text or "", flags=re.A) for r in left.collect()) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in TEXTS})


def test_unique_rows_pass_the_filter_by(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") % 10).cast("string"), 256)).alias("sha"))
    known = exact_dedup.repeated_filter(rows).withColumnRenamed("word", "w")
    word, bits = bloom.signature("sha")
    met = rows.select("sha", word, bits).join(known, F.expr("w = word AND (bits & filter) = bits"))
    assert 1010 <= met.count() <= 1030  # the 1000 copies, the ten they are copies of, and hardly any other
    assert known.count() <= 30
