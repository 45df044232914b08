"""Secret scans: candidates found by shape, then judged by how many owners and repositories of the corpus have them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.tables import written

#: Kinds in the order in which spans at one place are listed; `live` is what the corpus-wide count adds.
KINDS = ("assign", "access", "hex", "live")
# Fixed patterns of the three shapes, and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of as many or more; shorter runs fail anyway
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    found = []
    if _HINT.search(text):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def looks_random(value: str) -> bool:
    """Whether a value could be a credential by its make: not one sign again and again, and not letters only."""
    return len(set(value)) >= 6 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = 3, live_repositories: int = 3, example_repositories: int = 10) -> DataFrame:
    """Every candidate of every text with its corpus-wide ownership: found (kind, start, end, value_hash, owners, repositories,
    verdict), a list for each row, beside doc_id, n_assign, n_access, n_hex and base_sha256.

    Values are hashed where they are found; distinct owners and repositories are counted for each hash over the whole
    corpus. `example`: at least example_owners owners or at least example_repositories repositories have it, a value that is
    copied around; `live`: one owner only, in live_repositories repositories at most, and it looks random; `shared`:
    anything between. Positions are code points, ends exclusive. base_sha256 is that of
    kind:start:end, comma-joined, of all found.

    A null text is empty; a null owner counts as one owner, a null repository as one for each text; repeated rows are
    reported each but are one repository; an empty table gives no rows; other columns are ignored.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.string()), ("random", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("base_sha256", pa.string()), ("base", pa.list_(one))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, sums = [], []
            for text in batch.column(4):
                got = candidates(text.as_py() or "")
                base.append([{"kind": k, "start": a, "end": b, "value_hash": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)} for k, a, b, v in got])
                sums.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in got).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.string()), pa.array(base, pa.list_(one))], schema=schema)

    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository")]
    rows = written(
        docs.select(*key, "text").mapInArrow(
            run, "doc_id long, tag long, owner string, repository string, base_sha256 string, base array<struct<kind:string,start:int,end:int,value_hash:string,random:boolean>>"
        )
    )
    each = rows.select("doc_id", "tag", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.concat(F.lit("null "), "tag")).alias("repository"), F.explode("base").alias("c")).select("*", "c.*").drop("c", "base")
    # repositories belong to owners: fold them one level at a time, each before its shuffle
    by_owner = each.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("x")).groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("r"))
    owned = by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories), "example")
    verdict = verdict.when((F.col("owners") == 1) & (F.col("repositories") <= live_repositories) & F.col("random"), "live").otherwise("shared")
    judged = each.join(owned, "value_hash").withColumn("verdict", verdict)
    place = F.struct("start", "end", "kind", "value_hash", "owners", "repositories", "verdict")
    lists = judged.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(place)).alias("found")).withColumnRenamed("doc_id", "of").withColumnRenamed("tag", "of_tag")
    kinds = [F.size(F.filter(F.col("base.kind"), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    joined = rows.join(lists, rows.doc_id.eqNullSafe(lists.of) & (rows.tag == lists.of_tag), "left")
    return joined.select("doc_id", "tag", *kinds, "base_sha256", F.coalesce("found", F.array().cast("array<struct<start:int,end:int,kind:string,value_hash:string,owners:bigint,repositories:bigint,verdict:string>>")).alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """scan's rows with spans: kind:start:end of all candidates, and live:start:end of those judged live, comma-joined by
    start, then kind as in KINDS."""
    order = F.array(*map(F.lit, KINDS))
    base = F.transform("found", lambda c: F.struct(c["start"].alias("start"), F.array_position(order, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    live = F.transform(F.filter("found", lambda c: c["verdict"] == "live"), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).cast("long").alias("rank"), c["end"].alias("end"), F.lit("live").alias("kind")))
    listed = F.transform(F.array_sort(F.concat(base, live)), lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"]))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(listed, ",").alias("spans"), F.size(live).cast("long").alias("n_live"))
