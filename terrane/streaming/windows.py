"""Structured Streaming over tables of events (ts, and further columns): windows, sessions, repeats, live statistics.

Operators take and return streaming DataFrames; they work on batch ones too, apart from live_statistics. `drained` runs one
until its source has nothing new and gives its result as a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.sources.tables import scratch


def stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """The Parquet files at path (a file, a folder or a pattern) as a stream, those that come later included."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if "*" in path else f"{path}*")
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed(events: DataFrame, size: str, keys: list[str], value: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, keys, n, total, low, high of tumbling windows, or of sliding ones. State of windows that ended `late` before the
    latest event is dropped, and so are events that come for them."""
    v = F.col(value)
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), *keys)
    return g.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")).select(F.col("w.start").alias("start"), *keys, "n", "total", "low", "high")


def sessions(events: DataFrame, gap: str, key: str, value: str, late: str = "1 day") -> DataFrame:
    """key, start, stop, n, total of sessions, which end when `gap` passes without an event."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return g.agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; a repeat is known while the watermark has not passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def live_statistics(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, average, variance (0 for fewer than two values), low, high of all values so far. The state of a key is five
    numbers, and rows of a batch come in pieces, so a key of any size fits."""
    state = "n long, average double, m2 double, low double, high double"

    def add(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, low, high = held.get if held.exists else (0, 0.0, 0.0, math.inf, -math.inf)
        for frame in frames:
            x = frame[value].dropna()
            if len(x):
                more, m = len(x), float(x.mean())
                m2 += float(((x - m) ** 2).sum()) + (m - mean) ** 2 * n * more / (n + more)
                mean += (m - mean) * more / (n + more)
                n, low, high = n + more, min(low, float(x.min())), max(high, float(x.max()))
        held.update((n, mean, m2, low, high))
        some = n > 0
        yield pd.DataFrame({key: [k[0]], "n": [n], "average": [mean if some else None], "variance": [m2 / (n - 1) if n > 1 else 0.0], "low": [low if some else None], "high": [high if some else None]})

    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n long, average double, variance double, low double, high double"
    return events.select(key, value).groupBy(key).applyInPandasWithState(add, out, state, "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The result of a streaming df: every batch is written to a folder of its own, again if it is tried again, and of rows
    with the same keys the latest counts (mode complete: the last batch, as sessions need, which grow together)."""
    spark = df.sparkSession
    out = scratch(spark, "stream")
    save = lambda batch, nr: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={nr}")
    query = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").select(df.columns)
    rest = [c for c in df.columns if c not in keys]
    if mode == "append" or not rest:
        return rows.select(df.columns)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(df.columns)
