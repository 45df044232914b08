"""Bloom filters of bounded size as DataFrames: rows that a filter does not know need not be shuffled to a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter at most, and so rows that are broadcast at most (16 bytes each).
WORDS = 1 << 20
#: The column that tested() adds.
KNOWN = "bloom known"


def signature(hashed: str, words: int = WORDS) -> list[Column]:
    """The word of the filter that a 64-bit hash (SQL) belongs to, and four bits of it."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({hashed}, 1), {6 * k}) & 63 as int))" for k in range(4))
    return [F.pmod(F.xxhash64(F.expr(hashed)), F.lit(words)).alias("word"), F.expr(bits).alias("bits")]


def made(signed: DataFrame) -> DataFrame:
    """(word, filter) of rows with word and bits; as many rows as the filter has words at most."""
    return signed.groupBy("word").agg(F.bit_or("bits").alias("filter"))


def tested(rows: DataFrame, known: DataFrame, hashed: str, words: int = WORDS) -> DataFrame:
    """rows with KNOWN: whether the filter may hold their hash (true for all that it holds, for few others). Its size
    does not grow: with much more than 10 million hashes it lets more rows through, until `words` is raised."""
    word, bits = signature(hashed, words)
    known = known.select(F.col("word").alias("bloom word"), F.col("filter").alias("bloom filter"))
    marked = rows.select("*", word.alias("bloom word"), bits.alias("bloom bits")).join(F.broadcast(known), "bloom word", "left")
    holds = F.col("bloom filter").bitwiseAND(F.col("bloom bits")) == F.col("bloom bits")
    return marked.withColumn(KNOWN, F.coalesce(holds, F.lit(False))).drop("bloom word", "bloom bits", "bloom filter")


def beside(rows: DataFrame, others: DataFrame, hashed: str, others_hashed: str, on, how: str, words: int = WORDS) -> DataFrame:
    """rows joined to others (inner or left), where rows that others surely lacks are not shuffled. hashed, others_hashed:
    SQL of a 64-bit hash that is equal where `on` holds. others is read twice: a written table or cheap to make."""
    found = tested(rows, made(others.select(*signature(others_hashed, words))), hashed, words)
    met = found.where(F.col(KNOWN)).drop(KNOWN).join(others, on, how)
    return met if how == "inner" else met.unionByName(found.where(~F.col(KNOWN)).drop(KNOWN), allowMissingColumns=True)
