"""Queries of file formats (what is written is read again) and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.plans.registry import query, r
from terrane.plans.views import G, L, grid, load, logs
from terrane.sources import segy, text
from terrane.sources.tables import scratch
from terrane.streaming import windows

_YEARS = (1990, 2002)


def _segy_written(spark, sf, samples):
    """The grid as traces along z, as a SEG-Y store that was just written."""
    segy.register(spark)
    cells = grid(spark, sf).groupBy("inl", "crl").agg(F.map_from_entries(F.collect_list(F.struct("z", F.floor("val").cast("double")))).alias("m"))
    along = F.transform(F.sequence(F.lit(_YEARS[0]), F.lit(_YEARS[1] - 1)), lambda z: F.coalesce(F.col("m")[z.cast("long")], F.lit(0.0)).cast("float"))
    traces = cells.select(F.lit(1).alias("trace_nr"), F.col("inl").cast("int"), F.col("crl").cast("int"), F.lit(0).alias("offset"), F.lit(4000).alias("dt"), along.alias("samples"))
    path = scratch(spark, "segy")
    traces.write.format("segy").option("samples", samples).mode("append").save(path)
    return spark, path


def _segy_store(spark, sf, samples):
    return spark.read.format("segy").option("split", 1 << 20).load(_segy_written(spark, sf, samples)[1])


@query(f"WITH {G}, n AS (SELECT DISTINCT inl, crl FROM g) SELECT CAST(n.inl AS INTEGER) AS inl, CAST(n.crl AS INTEGER) AS crl, z.z AS z, coalesce(floor(g.val), 0) AS val FROM n CROSS JOIN range({_YEARS[0]}, {_YEARS[1]}) z(z) LEFT JOIN g ON g.inl = n.inl AND g.crl = n.crl AND g.z = z.z")
def q_segy_samples(spark, sf):
    rows = _segy_store(spark, sf, "hexadecimal").select("inl", "crl", F.posexplode("samples").alias("k", "v"))
    return rows.select("inl", "crl", (F.col("k") + _YEARS[0]).cast("long").alias("z"), F.col("v").cast("double").alias("val"))


@query(f"WITH {G}, n AS (SELECT DISTINCT inl, crl FROM g WHERE inl % 7 = 3 AND crl > 4) SELECT CAST(n.inl AS INTEGER) AS inl, CAST(n.crl AS INTEGER) AS crl, coalesce(sum(floor(g.val)) FILTER (g.z >= {_YEARS[0]} AND g.z < {_YEARS[1]}), 0) AS total FROM n LEFT JOIN g ON g.inl = n.inl AND g.crl = n.crl GROUP BY 1, 2")
def q_segy_index(spark, sf):
    """Every seventh inline and the last crosslines of a stored cube, by an index of its positions."""
    _, path = _segy_written(spark, sf, "ieee")
    index = scratch(spark, "segy_index")
    segy.write_index(spark, path, index, traces=4)
    inls = load(spark, sf, "lineitem").where("l_suppkey % 7 = 3").select(F.col("l_suppkey").alias("inl"))
    rows = segy.read_lines(spark, path, index, inls, F.col("crl_max") > 4).where("crl > 4")
    return rows.select("inl", "crl", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {G}, n AS (SELECT inl, crl FROM g GROUP BY ALL) SELECT count(*) AS traces, CAST(min(inl) AS INTEGER) AS first_inl, CAST(max(inl) AS INTEGER) AS last_inl, count(DISTINCT crl) AS crls, CAST(0 AS BIGINT) AS repeats, 12 AS samples, 4000 AS dt FROM n")
def q_segy_scan(spark, sf):
    heads = _segy_store(spark, sf, "ieee").groupBy("inl", "crl").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("samples")).alias("samples"), F.max("dt").alias("dt"))
    return heads.agg(
        F.sum("n").alias("traces"), F.min("inl").alias("first_inl"), F.max("inl").alias("last_inl"), F.count_distinct("crl").alias("crls"),
        F.sum(F.col("n") - 1).alias("repeats"), F.max("samples").alias("samples"), F.max("dt").alias("dt"),
    )


@query(f"WITH {L} SELECT well, log, dah, val FROM l WHERE val IS NOT NULL")
def q_las_logs(spark, sf):
    rows = logs(spark, sf)
    curves = [row.log for row in rows.select("log").distinct().orderBy("log").collect()]
    wide = rows.select("well", "dah", *[F.when(F.col("log") == c, F.col("val")).alias(c) for c in curves])
    path = scratch(spark, "las")
    text.write_las(wide, path, curves)
    return text.read_las(spark, path).select(F.regexp_extract("path", r"well=(\d+)", 1).cast("long").alias("well"), "log", "dah", "val")


@query("SELECT s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, s_suppkey, s_name FROM supplier")
def q_geojson(spark, sf):
    path = scratch(spark, "geojson")
    text.features(load(spark, sf, "supplier"), "s_acctbal", "s_nationkey", ["s_suppkey", "s_name"]).write.text(path)
    return text.read_features(spark.read.text(path), "s_suppkey: bigint, s_name: string")


@query("SELECT p_partkey, p_name || chr(10) || '\"' || p_brand || ',' AS label, p_retailprice FROM part")
def q_csv_table(spark, sf):
    path = scratch(spark, "csv")
    rows = load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit('\n"'), "p_brand", F.lit(",")).alias("label"), "p_retailprice")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS a, p_type || ' \"x\"' AS b, CASE WHEN p_size > 10 THEN p_brand END AS c FROM part")
def q_white_space_table(spark, sf):
    path = scratch(spark, "columns")
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.concat("p_type", F.lit(' "x"')).alias("b"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("c"))
    rows.select(text.to_white_space(["a", "b", "c"]).alias("value")).write.text(path)
    return spark.read.text(path).select(*text.from_white_space(F.col("value"), ["a", "b", "c"]))


@query("SELECT 'INSERT INTO wells (s_suppkey, s_name, owner) VALUES (''' || s_suppkey || ''', ''' || replace(s_name, '''', '''''') || ''', ''me'');' AS statement FROM supplier")
def q_insert_statements(spark, sf):
    return load(spark, sf, "supplier").select(text.insert_statements("wells", ["s_suppkey", "s_name"], {"owner": "me"}).alias("statement"))


# ---- streams


def _events(spark, sf):
    return windows.stream(spark, f"{sf}/events.parquet")


def _plain(*times):
    """Times without a zone, as in the tables; totals rounded."""
    return {t: F.col(t).cast("timestamp_ntz") for t in times} | {"total": r("total", 4)}


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def q_stream_tumbling(spark, sf):
    return windows.drained(windows.windowed(_events(spark, sf), "1 hour", ["event_type"], "value"), ["start", "event_type"]).withColumns(_plain("start"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) - k * INTERVAL 1 hour AS start, event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events CROSS JOIN range(2) x(k) GROUP BY ALL")
def q_stream_sliding(spark, sf):
    return windows.drained(windows.windowed(_events(spark, sf), "2 hours", ["event_type"], "value", "1 hour"), ["start", "event_type"]).withColumns(_plain("start"))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 hour THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 hour AS stop, count(value) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def q_stream_sessions(spark, sf):
    return windows.drained(windows.sessions(_events(spark, sf), "2 hours", "user_id", "value"), ["user_id", "start", "stop"], "complete").withColumns(_plain("start", "stop"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_stream_without_repeats(spark, sf):
    got = windows.without_repeats(_events(spark, sf), ["user_id", "event_type"], "10000 days")
    return windows.drained(got.select("user_id", "event_type"), [], "append")


@query("SELECT user_id, count(value) AS n, round(avg(value), 8) AS average, round(coalesce(var_samp(value), 0), 8) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def q_stream_statistics(spark, sf):
    got = windows.drained(windows.live_statistics(_events(spark, sf), "user_id", "value"), ["user_id"])
    return got.withColumns({"average": r("average", 8), "variance": r("variance", 8)})
