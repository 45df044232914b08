"""Stages of the pipeline may be chained, repeated and run side by side; what stays of their tables."""

import os
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import language_id, tables

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark):
    return tables.shared_folder(spark)


def test_stages_chained_without_writing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    names = ["doc_id", "start", "length", "ids_crc32"]  # where pieces lie follows the order of rows
    assert rows_of(docs.select(*names)) == rows_of(corpus_pipeline.run(spark, SF).select(*names))


def test_calls_do_not_meet(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.secrets):
        one = stage(spark, docs.where("doc_id % 2 = 0"), SF)
        other = stage(spark, docs.where("doc_id % 2 = 1"), SF)
        assert not set(r.doc_id for r in one.collect()) & set(r.doc_id for r in other.collect())
        assert rows_of(one) == rows_of(stage(spark, docs.where("doc_id % 2 = 0"), SF))


def test_runs_side_by_side(spark):
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32"))) for _ in range(2)]
        one, other = (r.result() for r in runs)
    assert one == other and sum(one.values()) > 100


def test_tables_that_stay(spark, folder):
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.near_duplicates(spark, docs, SF).count()
    corpus_pipeline.repeated_passages(spark, docs, SF).count()
    assert len(set(os.listdir(folder)) - before) == 2
    with pytest.raises(ZeroDivisionError), tables.scratch(spark) as outlives:
        kept, lost = outlives(spark.range(3)), tables.written(spark.range(4))
        1 / 0
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        lost.count()


def test_sample_of_languages_is_bounded(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows = [(None, f"{word()} {word()}", "aa") for _ in range(5000)] + [(7, "one text", "aa")] * 3000 + [(k, f"{word()} {word()}", "bb") for k in range(900)] + [(None, "same", "cc")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    times, sample = language_id.sampled(docs, 100)
    assert times == {"aa": 8000, "bb": 900, "cc": 4000}
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert counts["bb"] == 100 and 40 <= counts["aa"] <= 100 and counts.get("cc", 0) <= 1
    assert sample.groupBy("lang", "text").count().where("count > 1").count() == 0
    assert language_id.sampled(docs, 10**6)[1].where(F.col("lang") == "cc").count() == 1
