"""Text formats: LAS well logs, GeoJSON, tables by white space, INSERT statements. All rows stay in the JVM but those of LAS."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources.segy import _filesystem

UNDEFINED = "-999.25"


# ---- LAS


def write_las(logs: DataFrame, path: str, curves: list[str], depth: str = "dah", key: str = "well") -> None:
    """One file for each well (folders well=... in one for each task), of a row for each depth. Lines of a well pass through
    one task in order, which writes and names its files itself; none of them is held."""
    head = [
        "~VERSION INFORMATION", "VERS. 2.0 : LAS", "WRAP. NO : one line for each depth", "~WELL INFORMATION", f"NULL. {UNDEFINED} : undefined",
        "~CURVE INFORMATION", f"DEPT.M : {depth}", *[f"{c}. : {c}" for c in curves], "~ASCII",
    ]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNDEFINED))
    rows = logs.select(key, F.lit(1).alias("part"), F.col(depth).cast("double").alias("at"), F.concat_ws(" ", text(depth), *[text(c) for c in curves]).alias("value"))
    heads = logs.select(key).distinct().select(key, F.lit(0).alias("part"), F.posexplode(F.array(*map(F.lit, head))).alias("at", "value"))
    both = rows.unionByName(heads.withColumn("at", F.col("at").cast("double")))
    n = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = both.repartition(n, key).sortWithinPartitions(key, "part", "at").select(F.col(key).cast("string").alias("key"), "value")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a file gets its name when it is whole; a second attempt writes the same again
        fs, base = _filesystem(path)
        task = TaskContext.get()
        folder, own = f"{base}/part-{task.partitionId():05d}", f"_writing-{task.taskAttemptId()}"
        out, name, files, now = None, "", 0, object()

        def close() -> None:
            out.close()
            fs.move(f"{folder}/{own}", name)

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    if out:
                        close()
                    now, files = k, files + 1
                    well = "__HIVE_DEFAULT_PARTITION__" if k is None else quote(k, safe=" ")
                    fs.create_dir(f"{folder}/{key}={well}", recursive=True)
                    name = f"{folder}/{key}={well}/log.txt"
                    out = fs.open_output_stream(f"{folder}/{own}")
                out.write(f"{value}\n".encode())
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """path, log, dah, val of every defined value of the files below path. Tasks list the folders in it; a file is read by
    one task, line by line. Names that begin with _ or . are left out."""
    fs, base = _filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(base)) if fs.get_file_info(base).type == pafs.FileType.Directory else [fs.get_file_info(base)]
    found = [f for f in found if f.type != pafs.FileType.NotFound and (f.path == base or not f.base_name.startswith(("_", ".")))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = _filesystem(path)[0]
        for batch in batches:
            for at, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                below = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if folder else []
                files = [f.path for f in below if f.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(at) :].split("/"))]
                yield pa.RecordBatch.from_arrays([pa.array(files if folder else [at], pa.string())], names=["path"])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = _filesystem(path)[0]
        for frame in frames:
            few, size = [], 0
            for where in frame["path"]:
                with fs.open_input_file(where) as f:
                    for part in _las(where, f.read().decode()):
                        few.append(part)
                        size += len(part)
                        if size >= 10000:
                            yield pd.concat(few)
                            few, size = [], 0
            if few:
                yield pd.concat(few)

    top = spark.createDataFrame([(f.path, f.type == pafs.FileType.Directory) for f in found], "path string, folder boolean")
    files = top.repartition(n).mapInArrow(listed, "path string").repartition(n)
    return files.mapInPandas(parse, "path string, log string, dah double, val double")


def _las(where: str, text: str) -> Iterator[pd.DataFrame]:
    section, curves, undefined, rows = "", [], float(UNDEFINED), []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith("~"):
            section = line[1:2].upper()
        elif section == "C":
            curves.append(line.split(".")[0].strip())
        elif section == "W" and line.split(".")[0].strip().upper() == "NULL":
            undefined = float(line.split(".", 1)[1].split(":")[0].split()[-1])
        elif section == "A":
            rows.append([float(x) for x in line.split()])
            if len(rows) == 10000:
                yield _long(where, curves, rows, undefined)
                rows = []
    if rows:
        yield _long(where, curves, rows, undefined)


def _long(where: str, curves: list[str], rows: list[list[float]], undefined: float) -> pd.DataFrame:
    wide = pd.DataFrame(rows, columns=curves)
    out = wide.melt(id_vars=curves[0], var_name="log", value_name="val").rename(columns={curves[0]: "dah"})
    out = out[out["val"] != undefined]
    return out.assign(path=where)[["path", "log", "dah", "val"]]


# ---- GeoJSON


def features(rows: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """value: a Point feature for each row; undefined properties are left out."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.select(F.to_json(feature).alias("value"))


def read_features(lines: DataFrame, properties: str) -> DataFrame:
    """x, y and the properties (a schema) of text rows that hold a feature each, or a collection of features."""
    feature = f"geometry struct<type: string, coordinates: array<double>>, properties struct<{properties}>"
    parsed = lines.select(F.from_json("value", f"type string, features array<struct<{feature}>>, {feature}").alias("j"))
    each = parsed.select(F.explode(F.when(F.col("j.type") == "FeatureCollection", F.col("j.features")).otherwise(F.array(F.struct("j.geometry", "j.properties")))).alias("f"))
    return each.select(F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), "f.properties.*")


# ---- tables


def to_white_space(columns: list[str]) -> Column:
    """Columns in one line with blanks between; text is quoted, quotes in it doubled; undefined values are 1e30."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(" ", *[F.coalesce(quoted(c), F.lit("1e30")) for c in columns])


def from_white_space(line: Column, names: list[str]) -> list[Column]:
    """The fields of such a line; a field is a quoted text or a run without blanks."""
    fields = F.regexp_extract_all(line, F.lit(r'("(?:[^"]|"")*"|\S+)'))

    def one(i: int, name: str) -> Column:
        f = F.get(fields, F.lit(i))
        bare = F.replace(F.substring(f, 2, 1 << 30).substr(F.lit(1), F.length(f) - 2), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"'), bare).when(f != "1e30", f).alias(name)

    return [one(i, n) for i, n in enumerate(names)]


def insert_statements(table: str, columns: list[str], constants: dict[str, str] | None = None) -> Column:
    """An INSERT statement for each row; text is quoted, undefined values are NULL."""
    constants = constants or {}
    value = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    values = [value(F.col(c)) for c in columns] + [value(F.lit(v)) for v in constants.values()]
    listed = reduce(lambda a, b: F.concat(a, F.lit(", "), b), values)
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join([*columns, *constants])}) VALUES ("), listed, F.lit(");"))


# ---- tables of described columns


def read_columns(spark: SparkSession, path: str, fields: dict[str, tuple[int, str, float]], comment: str = "#", undefined: float = 1e30) -> DataFrame:
    """Lines of columns split by white space, as horizons, faults, pick sets, wells and velocity functions come in plain text.

    fields: for each name its column (from 1), its type, and a factor to the unit wanted (numbers other than 1.0 only).
    Lines that are blank or start with comment are left out; a column that is missing, no number or undefined is null.
    """
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith(comment)).select(F.split("line", " ").alias("c"))

    def field(name: str) -> Column:
        column, kind, factor = fields[name]
        raw = F.get("c", F.lit(column - 1))
        if kind == "string":
            return raw.alias(name)
        number = raw.try_cast("double")
        value = raw.try_cast(kind) if factor == 1.0 else (number * factor).cast(kind)
        return F.when(number != undefined, value).alias(name)

    return rows.select(*map(field, fields))
