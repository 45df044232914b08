"""The corpus pipeline: documents in, packed token windows out, through five stages of terrane.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of documents (doc_id, text, lang,
source, n_chars), and so has what every stage but the last returns. Other columns of docs are left out first, whatever
their names. What a stage returns may be used whenever and as often as one likes: a stage removes only tables of its own that
nothing reads any more (see scratch), and each call makes its own. All stages take an empty table (and return one), nulls
in any column, texts of any length and repeated rows; what each does with them is said there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bloom, jaccard_join, language_id, packing, secret_scan, suffix_dedup
from terrane.llm.repeats import with_text
from terrane.llm.tables import load, removed, scratch, shared_folder, small_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What a stage reads of docs; texts come to Python in small batches."""
    small_batches(spark)
    return docs.select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go, null and empty texts and those without letters among them; lang becomes
    what it says. Null ids and repeated rows are judged like others."""
    docs = columns(spark, docs)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model, keep=COLUMNS)
    return found.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one doc_id and one text, one stays, by least source; of documents linked by five-word shingles
    (similarity 0.8 or more), the one with the least doc_id.

    Documents are told apart by `row`, a 64-bit hash of doc_id and text: null ids are one document for each text, and
    come last in their group; of one id's linked texts the one of least hash stays. Null and empty texts link to nothing:
    one stays of each id. Ties of the least source go by n_chars, lang.
    """
    docs = columns(spark, docs)
    row = F.xxhash64("doc_id", "text").alias("row")
    with scratch(spark) as outlives:
        linked = jaccard_join.similar_components(docs.select(row.alias("doc_id"), "text"), 5, 80)
        linked = linked.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component_id"))
        ids = docs.select("doc_id", row).groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
        known = written(linked.join(ids, "row"))
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
        stays = known.groupBy("component_id").agg(first.alias("row")).select("row", F.lit(True).alias("stays"))
        # what is not as it was: rows that go, and rows that there are several of
        touched = outlives(known.select("row", "rows").join(stays, "row", "left").where("stays IS NULL OR rows > 1").select(F.col("row").alias("of"), F.coalesce("stays", F.lit(False)).alias("stays")))
    rows = docs.select("*", row)
    beside = bloom.beside(rows, touched, "row", "of", rows.row == touched.of, "left")
    same = beside.where("stays").groupBy("row").agg(F.min(F.struct("source", "n_chars", "lang", "doc_id", "text")).alias("d"))
    return beside.where("stays IS NULL").select(*COLUMNS).unionByName(same.select(*(F.col(f"d.{c}") for c in COLUMNS)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 bytes or more that also start elsewhere are cut wherever they stand, no copy stays; a text that
    is cut goes if nothing but ASCII white space is left of it. Texts without such strings stay as they are, null ones too.
    """
    found = suffix_dedup.remove_repeats(columns(spark, docs), 200, keep=COLUMNS[1:])
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~cut | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live, which one owner alone has, are masked; the rest of the text stays, and so does every
    row. Null texts stay null; overlapping credentials are masked as one."""
    docs = columns(spark, docs)
    with scratch(spark) as outlives:
        live = secret_scan.scan(docs).select("doc_id", "tag", F.filter("found", lambda c: c["verdict"] == "live").alias("live")).where(F.size("live") > 0)
        live = outlives(live.dropDuplicates(["doc_id", "tag"]))
    joined = with_text(docs, live, "left")
    # spans come by start and may overlap: `done` is where the text is copied up to
    masked = F.aggregate(
        "live",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("done")),
        lambda state, c: F.struct(
            F.when(c["start"] >= state["done"], F.concat(state["out"], F.col("text").substr(state["done"] + 1, c["start"] - state["done"]), F.lit("[secret]")))
            .otherwise(state["out"])
            .alias("out"),
            F.greatest(state["done"], c["end"]).alias("done"),
        ),
        lambda state: F.concat(state["out"], F.col("text").substr(state["done"] + 1, F.length("text"))),
    )
    text = F.when(F.col("live").isNotNull(), masked).otherwise(F.col("text"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", "n_chars").withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048: a row for each piece of each document; a null text is the end id alone."""
    return packing.pack(columns(spark, docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", identify), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("secret scans", secrets), ("packing", windows)]

#: SQL can't express the stages; a test holds what run() returns against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written before the next, in a folder of this run; an empty table gives
    no rows. What a stage was made from is removed once it is written; the last stage reads its tables, which stay."""
    docs, folder, before = load(spark, sf_dir, "documents"), f"{shared_folder(spark)}/terrane-run-{uuid.uuid4().hex}", None
    for k, (_, f) in enumerate(STAGES[:-1]):
        with scratch(spark):
            made = f(spark, docs, sf_dir)
            made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
        if before is not None:
            removed(spark, [f"{folder}/{before}"])
        before = k
    return STAGES[-1][1](spark, docs, sf_dir)
