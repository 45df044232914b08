"""Exact dedup: a Bloom filter of repeated hashes, made in a first pass, lets unique rows by; only the rest shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import bloom
from terrane.llm.bloom import WORDS
from terrane.llm.tables import joined_groups, written

#: What normalised texts lack.
SPACE = r"[\x20\x09-\x0D]"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def repeated_filter(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(word, filter): the Bloom filter of all hashes that may occur twice among rows (sha), `words` rows at most.

    The first pass. Each hash has a signature, one word and four bits in it. Signatures are counted, with most of the
    counting before the shuffle; those found twice set their bits. Equal hashes have equal signatures, so none is missed.
    """
    return bloom.made(rows.select(*bloom.signature("sha", words)).groupBy("word", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def mark(docs: DataFrame, keep: list[str] = (), words: int = WORDS) -> DataFrame:
    """Which row stays of each group of equal texts: doc_id, keep_id, group_size, kept, text_sha256, and the columns `keep`.

    Texts are equal if the SHA-256 of what is left without ASCII white space is equal. Of a group, the row with the most
    code points in its original text stays, then the one with the least doc_id (null last), then the first read; so exactly
    one row of each group is kept, of repeated rows too. A null text is an empty one; texts of white space equal it.
    keep_id is null where the row that stays has a null id. An empty table gives no rows; columns that are not named in
    `keep` are ignored, whatever their names; texts are read whole, by JVM functions, of any length that a row can hold.

    The first pass writes what identifies each row (not its text) to the shared folder and makes the filter
    (repeated_filter). In the second, rows that the filter does not know pass straight through: no shuffle. The others
    meet by hash. The filter's size does not grow: with much more than 10 million repeated hashes it lets more unique rows
    shuffle, until `words` is raised; results stay the same.
    """
    kept = [F.col(f"`{c}`").alias(f"kept {k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("size"), F.unhex(F.sha2(normal(F.col("text")), 256)).alias("sha"), *kept)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    tested = bloom.tested(rows, repeated_filter(rows, words), "sha", words)
    first = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    met = tested.where(F.col(bloom.KNOWN))
    groups = written(met.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    groups = groups.select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    shape = [*(F.col(f"kept {k}").alias(c) for k, c in enumerate(keep))]
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = tested.where(~F.col(bloom.KNOWN)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, *shape)
    together = joined_groups(met, groups, "sha", "group_size", rows.count())
    together = together.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), sha, *shape)
    return alone.unionByName(together)


def deduplicate(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """The rows that stay (see mark), with doc_id and the columns `keep`, such as text."""
    return mark(docs, [c for c in keep if c != "doc_id"], words).where("kept").select("doc_id", *(F.col(f"`{c}`") for c in keep if c != "doc_id"))
