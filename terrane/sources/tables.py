"""Loading the driver's tables, and a folder that all executors see for what a job writes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only where that is unset on one machine, as in tests, in a folder of its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    return f"{(at or tempfile.mkdtemp(prefix='terrane-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a scratch path and read again: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, "terrane")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where a step's memory goes with them.
ROWS = 100_000
_PARTS = "spark.sql.shuffle.partitions"


def parts_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as shuffles have, or more, so that each of them gets ROWS rows or so."""
    return max(int(spark.conf.get(_PARTS)), -(-rows // ROWS))


@contextlib.contextmanager
def more_parts(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is written within have parts_for(rows) parts."""
    before = spark.conf.get(_PARTS)
    spark.conf.set(_PARTS, str(parts_for(spark, rows)))
    try:
        yield
    finally:
        spark.conf.set(_PARTS, before)
