import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.sources import segy, text
from terrane.streaming import windows


def test_hexadecimal_floats():
    # -118.625 is the textbook example of this format
    assert segy.to_hexadecimal(np.array([-118.625]))[0] == 0xC276A000
    x = np.concatenate([[0.0, 1.0, -1.0, 0.1, 1e-20, 7.2e20, 15.9999999, float("nan")], np.random.default_rng(1).normal(scale=1000, size=2000)])
    back = segy.from_hexadecimal(segy.to_hexadecimal(x))
    want = np.nan_to_num(x)
    assert np.allclose(back, want, rtol=2**-20, atol=0)


@pytest.mark.parametrize("samples", ["hexadecimal", "ieee"])
@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_segy_keeps_traces_whatever_the_split(spark, tmp_path, samples, split):
    segy.register(spark)
    rows = [(k, k // 10, k % 10, k * 25, 4000, [float(k + j) for j in range(20 if k < 60 else 31)]) for k in range(100)]
    spark.createDataFrame(rows, segy.SCHEMA).repartition(3).write.format("segy").option("samples", samples).mode("append").save(str(tmp_path / "s"))
    got = spark.read.format("segy").option("split", split).load(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_segy_overwrites_and_ignores_what_has_no_name(spark, tmp_path):
    segy.register(spark)
    path = str(tmp_path / "s")
    one = spark.createDataFrame([(1, 2, 3, 0, 4000, [1.0])], segy.SCHEMA)
    for mode in ("append", "overwrite"):
        one.write.format("segy").mode(mode).save(path)
    (tmp_path / "s" / "_writing-x").mkdir()
    (tmp_path / "s" / "_writing-x" / "part.sgy").write_bytes(b"lost")
    assert spark.read.format("segy").load(path).count() == 1
    one.write.format("segy").mode("append").save(path)
    assert spark.read.format("segy").load(path).count() == 2


def test_las_reads_other_headers(spark, tmp_path):
    (tmp_path / "a.las").write_text("~V\nVERS. 2.0 : x\n~W\nNULL. -9999 : none\n# remark\n~C\nDEPT.M : d\nGR.API : g\nDT.US/M : t\n~A\n1.0 50 -9999\n2.0 -9999 3.5\n")
    got = text.read_las(spark, str(tmp_path)).select("log", "dah", "val").collect()
    assert sorted(map(tuple, got)) == [("DT", 2.0, 3.5), ("GR", 1.0, 50.0)]


def test_geojson_collections(spark):
    lines = [('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"n":"a"}}]}',), ('{"type":"Feature","geometry":{"type":"Point","coordinates":[3,4]},"properties":{}}',)]
    got = text.read_features(spark.createDataFrame(lines, "value string"), "n: string")
    assert sorted(map(tuple, got.collect())) == [(1.0, 2.0, "a"), (3.0, 4.0, None)]


def test_late_events_are_dropped_and_new_files_are_added(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    row = lambda *ts: spark.createDataFrame([(f"2024-01-{t}", 1, 1.0) for t in ts], "ts string, k long, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    row("01 00:10:00", "09 00:00:00").write.parquet(path)
    events = windows.stream(spark, path)
    query = windows.windowed(events, "1 hour", ["k"], "value", late="1 day").writeStream.format("memory").queryName("late_test").outputMode("update").start()
    query.processAllAvailable()
    row("01 00:20:00", "09 00:30:00").write.mode("append").parquet(path)
    query.processAllAvailable()
    query.stop()
    n = {str(r["start"]): r["n"] for r in spark.sql("SELECT start, max(n) AS n FROM late_test GROUP BY start").collect()}
    assert n == {"2024-01-01 00:00:00": 1, "2024-01-09 00:00:00": 2}


def test_live_statistics_over_several_batches(spark, tmp_path):
    path, x = str(tmp_path / "e.parquet"), np.random.default_rng(3).normal(50, 9, 300)
    df = spark.createDataFrame([(k % 3, float(v) if k % 7 else None) for k, v in enumerate(x)] + [(9, None)], "k long, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.repartition(4).write.parquet(path)
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["k"]: r for r in windows.drained(windows.live_statistics(rows, "k", "value"), ["k"]).collect()}
    for k in range(3):
        want = np.array([v for i, v in enumerate(x) if i % 3 == k and i % 7])
        assert got[k]["n"] == len(want) and abs(got[k]["variance"] - want.var(ddof=1)) < 1e-8 and got[k]["low"] == want.min()
    assert got[9]["n"] == 0 and got[9]["average"] is None


def test_segy_index_reads_what_is_asked_for(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    segy.register(spark)
    path, index = str(tmp_path / "cube"), str(tmp_path / "index")
    rows = [(0, i, j, 0, 4000, [float(i), float(j)] * 20) for i in range(60) for j in range(50)]
    spark.createDataFrame(rows, segy.SCHEMA).repartitionByRange(4, "inl").sortWithinPartitions("inl", "crl").write.format("segy").mode("append").save(path)
    segy.write_index(spark, path, index, traces=10, split=30_000)
    assert spark.read.parquet(index).selectExpr("sum(traces)").first()[0] == 3000
    read = lambda: spark.read.format("segy").option("index", index).load(path)
    want = lambda keep: sorted((i, j) for _, i, j, *_ in rows if keep(i, j))
    for sql, keep in (("inl = 7", lambda i, j: i == 7), ("inl in (3, 40) and crl > 44", lambda i, j: i in (3, 40) and j > 44), ("inl > 57 or crl = 2", lambda i, j: i > 57 or j == 2), ("inl = 99", lambda i, j: False), ("offset = 0", lambda i, j: True), ("inl is null", lambda i, j: False), ("size(samples) = 40 and inl <= 1", lambda i, j: i <= 1)):
        got = read().where(sql).select("inl", "crl", "samples").collect()
        assert sorted((r.inl, r.crl) for r in got) == want(keep), sql
        assert all(r.samples == [float(r.inl), float(r.crl)] * 20 for r in got)
    size = lambda *filters: sum(r.high - r.low for r in reader(filters).partitions())

    def reader(filters):
        made = segy.SegyReader(path, 1 << 20, index)
        assert list(made.pushFilters(list(filters))) == list(filters)
        return made

    trace = 240 + 160
    assert size() >= 3000 * trace
    # whole blocks of ten, which begin where splits do
    assert 50 * trace <= size(EqualTo(("inl",), 7)) <= 70 * trace
    assert 10 * trace <= size(In(("inl",), (3, 40)), GreaterThan(("crl",), 44)) <= 50 * trace
    assert size(EqualTo(("inl",), 99)) == 0 and size(EqualTo(("samples",), 3)) >= 3000 * trace


def test_segy_index_prunes_a_query(spark, tmp_path):
    """Files that the index does not need are not opened."""
    segy.register(spark)
    path, index = tmp_path / "cube", str(tmp_path / "index")
    rows = [(0, i, j, 0, 4000, [1.0]) for i in range(8) for j in range(5)]
    spark.createDataFrame(rows, segy.SCHEMA).repartitionByRange(8, "inl").write.format("segy").mode("append").save(str(path))
    segy.write_index(spark, str(path), index)
    kept = spark.read.parquet(index).where("inl_min <= 3 and inl_max >= 3").first().path
    for f in path.iterdir():
        if f.is_file() and str(f) != kept:
            f.write_bytes(b"broken")
    assert spark.read.format("segy").option("index", index).load(str(path)).where("inl = 3").count() == 5


def test_segy_lines_of_a_table(spark, tmp_path):
    """The lines wanted come as a table: their blocks are read, exactly, and files without them are not opened."""
    segy.register(spark)
    path, index = tmp_path / "cube", str(tmp_path / "index")
    rows = [(0, i, j, 0, 4000, [float(i), float(j)]) for i in range(40) for j in range(9)]
    spark.createDataFrame(rows, segy.SCHEMA).repartitionByRange(4, "inl").sortWithinPartitions("inl", "crl").write.format("segy").mode("append").save(str(path))
    segy.write_index(spark, str(path), index, traces=4, split=3600 + 30 * 248)
    held = spark.read.parquet(index)
    assert held.selectExpr("sum(traces)").first()[0] == 360 and {r.traces == len(r.inls) or len(set(r.inls)) == len(r.inls) for r in held.collect()} == {True}
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 3, 38, 99, None)], "inl long")
    needed = {r.path for r in held.where("exists(inls, x -> x in (3, 5, 38))").collect()}
    for f in path.iterdir():
        if f.is_file() and str(f) not in needed:
            f.write_bytes(b"broken")
    got = segy.read_lines(spark, str(path), index, wanted, F.col("crl_max") > 4, split=1000).where("crl > 4").collect()
    assert sorted((r.inl, r.crl, *r.samples) for r in got) == [(i, j, float(i), float(j)) for i in (3, 5, 38) for j in range(5, 9)]
    assert segy.read_lines(spark, str(path), index, wanted.limit(0)).count() == 0


def test_las_files_are_named_by_their_tasks(spark, tmp_path):
    """A whole file for each well in its task's folder, that the driver neither moves nor lists; unfinished ones are not read."""
    path = tmp_path / "las"
    rows = [(w, float(d), float(w * d) if w is not None and d % 3 else None) for w in (1, 2, 30, None) for d in range(5)]
    text.write_las(spark.createDataFrame(rows, "well long, dah double, gr double"), str(path), ["gr"])
    files = [f.relative_to(path) for f in path.rglob("*.txt")]
    assert len(files) == 4 and all(f.parts[0].startswith("part-") and f.parts[1].startswith("well=") for f in files)
    (path / files[0].parts[0] / "_writing-9").write_text("broken")
    got = text.read_las(spark, str(path)).selectExpr("cast(regexp_extract(path, 'well=([0-9]+)', 1) as long) AS well", "log", "dah", "val").collect()
    assert sorted(map(tuple, got)) == sorted((w, "gr", d, v) for w, d, v in rows if v is not None)
