"""The queries of this subpackage, each with its production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import (
    byte_bpe,
    exact_dedup,
    jaccard_join,
    language_id,
    packing,
    periodic_runs,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    token_counts,
    transport_stream,
    vector_search,
)
from terrane.llm.tables import load


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_features(load(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"), 35, keep_text=False).drop("kept_text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    found = language_id.predict(docs, language_id.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.spans(secret_scan.scan(load(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(load(spark, sf_dir, "documents"), 3, 90)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), 200, keep_text=False).drop("kept_text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(load(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(load(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_byte_bpe, op3_transport_stream, op4_substring_dedup, op5_language_id,
        op6_vector_search, op7_secret_scan, op8_packing, op9_jaccard_join, op10_suffix_dedup,
        op11_token_alignment, op12_exact_dedup, op13_periodic_runs,
    )
}

SQL: dict[str, str] = {
    "op12_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
            row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY t ORDER BY size DESC, doc_id)
    """,
    "op6_vector_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
