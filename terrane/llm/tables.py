"""Reading the corpus tables, and cutting lineage with a written table in the shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that come to a Python worker at a time: Spark's own limit holds ten times the memory at a time.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, _UNSET = 4 << 20, (64 << 20) + 1


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH to BATCH_BYTES for this session, unless it has a limit of its own."""
    if spark.conf.get(BATCH, str(_UNSET)) == str(_UNSET):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset on one machine, as in tests, a folder of its own. On a
    cluster without it this fails: executors would write to disks that others cannot read."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of the tables that written() has made in the innermost scratch() of this thread.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables; nothing that reads them may be in use any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written within are removed at the end, so no DataFrame made within may be used after it, but for what the
    function that it gives, outlives(df), has written: that belongs to the scratch around, if there is one."""
    around = _made.get()
    own: list[str] = []

    def outlives(df: DataFrame) -> DataFrame:
        inner = _made.set(around)
        try:
            return written(df)
        finally:
            _made.reset(inner)

    token = _made.set(own)
    try:
        yield outlives
    finally:
        _made.reset(token)
        removed(spark, own)


#: Whether Spark removes the files of a query's shuffles when it has ended, not at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it outlives lost executors and is computed once. The files
    of the shuffles that made it go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terrane-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key to as many tasks as shuffles have: what a task does grows faster than its bytes, so that small
    partitions must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: A group with more than this part of all rows is hot.
HOT_PARTS = 1000


def joined_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Each of rows with its group (inner join by key, which is not null; `size`: rows of the group, `total`: of all).

    Groups of over total / HOT_PARTS rows, HOT_PARTS at most, are broadcast, so that no task gets all rows of a hot key;
    the others meet their rows by a shuffle.
    """
    hot = groups.where(F.col(size) * HOT_PARTS > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) * HOT_PARTS <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
