"""SEG-Y trace files as a Spark data source: spark.read.format("segy").load(path), df.write.format("segy").save(path).

A row is a trace: trace_nr, inl, crl, offset (ints), dt (sample interval in microseconds) and samples (array<float>). Files are
split by byte ranges: a task reads the traces that begin in its range, so one huge file is read by many tasks, and a task
holds one block of traces at a time. Writing, every task writes files of its own, which get their names when the job commits:
what a lost executor or a second attempt left behind is never read.

write_index makes a table of the positions that each block of traces spans. With option("index", its path) and filters on inl,
crl, offset or trace_nr, only byte ranges of blocks that can hold such traces are read. read_lines takes the inlines wanted as a
table instead, however many: the index meets it in a join.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "trace_nr int, inl int, crl int, offset int, dt int, samples array<float>"
_ARROW = pa.schema([*[(n, pa.int32()) for n in ("trace_nr", "inl", "crl", "offset", "dt")], ("samples", pa.list_(pa.float32()))])
#: The format. Sizes of the headers, and offsets (from 0) of the fields that are used.
TEXT_SIZE, BINARY_SIZE, TRACE_HEADER = 3200, 400, 240
BINARY_FIELDS = {"dt": 16, "ns": 20, "format": 24}  # 16-bit, from the start of the binary header
TRACE_FIELDS = {"trace_nr": 0, "offset": 36, "inl": 188, "crl": 192}  # 32-bit
SAMPLE_TYPES = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}  # 1: hexadecimal floating point
START = TEXT_SIZE + BINARY_SIZE
BLOCK = 8 << 20


def from_hexadecimal(words: np.ndarray) -> np.ndarray:
    """32-bit hexadecimal floating point: sign, exponent of 16 (excess 64), 24-bit fraction."""
    words = words.astype(np.uint32)
    fraction = (words & 0x00FFFFFF).astype(np.float64)
    power = ((words >> 24) & 0x7F).astype(np.int32) - 64
    return (np.where(words >> 31, -1.0, 1.0) * np.ldexp(fraction, 4 * power - 24)).astype(np.float32)


def to_hexadecimal(values: np.ndarray) -> np.ndarray:
    """The nearest such number; undefined values become 0."""
    x = np.nan_to_num(np.asarray(values, np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    two = np.frexp(np.abs(x))[1]
    sixteen = -(-two // 4)
    fraction = np.rint(np.ldexp(np.abs(x), 24 - 4 * sixteen)).astype(np.int64)
    over = fraction >> 24  # rounding reached the next power
    fraction, sixteen = np.where(over, fraction >> 4, fraction), sixteen + over
    words = (np.where(x < 0, 1, 0) << 31) | ((np.clip(sixteen + 64, 0, 127)) << 24) | fraction
    return np.where(fraction == 0, 0, words).astype(np.uint32)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _record(ns: int, sample: str) -> np.dtype:
    return np.dtype({"names": [*TRACE_FIELDS, "samples"], "formats": [">i4"] * len(TRACE_FIELDS) + [(sample, (ns,))], "offsets": [*TRACE_FIELDS.values(), TRACE_HEADER], "itemsize": TRACE_HEADER + ns * np.dtype(sample).itemsize})


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


#: What an index has for each block of traces: where it lies, the least and greatest of each position, and its inlines.
INDEX = "path string, low long, high long, traces int, " + ", ".join(f"{n}_min int, {n}_max int" for n in TRACE_FIELDS) + ", inls array<int>"


def blocks_that_may(filters: list[Filter]):
    """The condition on an index's rows that a block must meet to hold traces that all filters accept; None if any may."""
    out = None
    for f in filters:
        name = f.attribute[0]
        low, high = pads.field(f"{name}_min"), pads.field(f"{name}_max")
        if isinstance(f, In):
            one = None
            for v in f.value:
                hit = (low <= v) & (high >= v)
                one = hit if one is None else one | hit
        elif isinstance(f, EqualTo):
            one = (low <= f.value) & (high >= f.value)
        else:
            one = high > f.value if isinstance(f, GreaterThan) else high >= f.value if isinstance(f, GreaterThanOrEqual) else low < f.value if isinstance(f, LessThan) else low <= f.value
        out = one if out is None or one is None else out & one
    return out


class SegyReader(DataSourceReader):
    def __init__(self, path: str, split: int, index: str | None = None):
        self.path, self.split, self.index, self.filters = path, split, index, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of positions with values choose blocks; Spark still holds every filter against the traces."""
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            if self.index and isinstance(f, kinds) and f.attribute[0] in TRACE_FIELDS and (f.value if isinstance(f, In) else f.value is not None):
                self.filters.append(f)
            yield f

    def partitions(self) -> list[Range]:
        wanted = blocks_that_may(self.filters)
        return self.whole() if wanted is None else self.indexed(wanted)

    def indexed(self, wanted) -> list[Range]:
        """The wanted blocks, those that touch as one range of the size of a split at most."""
        fs, path = _filesystem(self.index)
        got = pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table(["path", "low", "high"], filter=wanted).sort_by([("path", "ascending"), ("low", "ascending")])
        out: list[Range] = []
        for path, low, high in zip(*(got[c].to_pylist() for c in ("path", "low", "high"))):
            if out and out[-1].path == path and out[-1].high == low and high - out[-1].low <= self.split:
                out[-1].high = high
            else:
                out.append(Range(path, low, high))
        return out or [Range("", 0, 0)]

    def whole(self) -> list[Range]:
        fs, path = _filesystem(self.path)
        at = fs.get_file_info(path)
        files = [at] if at.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        base = path.rstrip("/") + "/"
        files = [f for f in files if f.type == pafs.FileType.File and not re.search(r"(^|/)[_.]", f.path.removeprefix(base) if f is not at else "")]
        return [Range(f.path, low, min(low + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for low in range(START, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with _filesystem(self.path)[0].open_input_file(partition.path) as f:
                yield from _traces(f, partition.low, partition.high)


def _traces(f, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The traces that begin in [low, high); the last one may end beyond."""
    header = f.read_at(BINARY_SIZE, TEXT_SIZE)
    dt, ns, code = (int.from_bytes(header[at : at + 2], "big") for at in BINARY_FIELDS.values())
    if code not in SAMPLE_TYPES:
        raise ValueError(f"sample format {code} is not known")
    record = _record(ns, SAMPLE_TYPES[code])
    first, stop = -(-(low - START) // record.itemsize), -(-(high - START) // record.itemsize)
    step = max(1, BLOCK // record.itemsize)
    for k in range(first, stop, step):
        data = f.read_at(min(step, stop - k) * record.itemsize, START + k * record.itemsize)
        rows = np.frombuffer(data, record, count=len(data) // record.itemsize)  # a trace cut short at the file's end is left out
        samples = rows["samples"].ravel()
        samples = from_hexadecimal(samples) if code == 1 else samples.astype(np.float32)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * ns)
        heads = {n: pa.array(rows[n].astype(np.int32)) for n in TRACE_FIELDS} | {"dt": pa.array(np.full(len(rows), dt, np.int32))}
        yield pa.RecordBatch.from_arrays([*[heads[n] for n in _ARROW.names[:-1]], pa.ListArray.from_arrays(ends, pa.array(samples))], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SegyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, code: int, overwrite: bool):
        self.path, self.code, self.job = path, code, uuid.uuid4().hex
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = _filesystem(self.path)
        folder = f"{path.rstrip('/')}/_writing-{self.job}"
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        out, key, files, nr = None, None, [], 0
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                lengths = np.diff(table["samples"].combine_chunks().offsets.to_numpy())
                dts = table["dt"].fill_null(0).to_numpy() if "dt" in table.column_names else np.zeros(len(lengths), int)
                # traces of one length and interval go to one file; another one begins where they change
                cuts = [0, *(np.flatnonzero((np.diff(lengths) != 0) | (np.diff(dts) != 0)) + 1).tolist(), len(lengths)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    ns, dt = int(lengths[i]), int(dts[i])
                    if key != (ns, dt):
                        if out:
                            out.close()
                        key, name = (ns, dt), f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.sgy"
                        out = fs.open_output_stream(f"{folder}/{name}")
                        files.append(name)
                        out.write(self._headers(ns, dt))
                    out.write(self._encoded(table.slice(i, j - i), ns, nr))
                    nr += j - i
        finally:
            if out:
                out.close()
        return Written(files)

    def _headers(self, ns: int, dt: int) -> bytes:
        if not (ns < 1 << 15 and dt < 1 << 15):
            raise ValueError("samples and interval of a trace must stay below 32768")
        binary = bytearray(BINARY_SIZE)
        for name, value in (("dt", dt), ("ns", ns), ("format", self.code)):
            binary[BINARY_FIELDS[name] : BINARY_FIELDS[name] + 2] = value.to_bytes(2, "big")
        return "".join(f"C{i:2d}".ljust(80) for i in range(1, 41)).encode("cp037") + bytes(binary)

    def _encoded(self, table: pa.Table, ns: int, nr: int) -> bytes:
        rows = np.zeros(len(table), _record(ns, SAMPLE_TYPES[self.code]))
        for name in TRACE_FIELDS:
            if name in table.column_names:
                rows[name] = table[name].fill_null(0).to_numpy()
            elif name == "trace_nr":
                rows[name] = np.arange(nr + 1, nr + 1 + len(table))
        values = table["samples"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), ns)
        rows["samples"] = to_hexadecimal(values) if self.code == 1 else np.nan_to_num(values)
        return rows.tobytes()

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _filesystem(self.path)
        path = path.rstrip("/")
        if self.overwrite and fs.get_file_info(path).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.type == pafs.FileType.File and f.base_name.endswith(".sgy"):
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{path}/_writing-{self.job}/{name}", f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing was given a name; the unnamed files are never read."""


class Segy(DataSource):
    """Options: path; split (bytes a task reads, 64 MB); samples (of writing: `hexadecimal`, the default, or `ieee`)."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SegyReader:
        return SegyReader(self.options["path"], int(self.options.get("split", 64 << 20)), self.options.get("index"))

    def writer(self, schema: StructType, overwrite: bool) -> SegyWriter:
        code = {"hexadecimal": 1, "ieee": 5}[self.options.get("samples", "hexadecimal")]
        return SegyWriter(self.options["path"], code, overwrite)


class SegyIndexReader(SegyReader):
    def __init__(self, path: str, split: int, traces: int):
        super().__init__(path, split)
        self.traces = traces

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _filesystem(self.path)[0].open_input_file(partition.path) as f:
            header = f.read_at(BINARY_SIZE, TEXT_SIZE)
            _, ns, code = (int.from_bytes(header[at : at + 2], "big") for at in BINARY_FIELDS.values())
            size = _record(ns, SAMPLE_TYPES[code]).itemsize
            at = START + -(-(partition.low - START) // size) * size
            names = [part.split()[0] for part in INDEX.split(", ")]
            for batch in _traces(f, partition.low, partition.high):
                heads = {n: batch.column(n).to_numpy() for n in TRACE_FIELDS}
                first = np.arange(0, batch.num_rows, self.traces)
                traces = np.diff(np.append(first, batch.num_rows))
                if not len(first):
                    continue
                low, block = at + first * size, np.repeat(np.arange(len(first)), traces)
                order = np.lexsort((heads["inl"], block))
                inl, block = heads["inl"][order], block[order]
                new = np.append(True, (np.diff(inl) != 0) | (np.diff(block) != 0))
                ends = np.append(0, np.cumsum(np.bincount(block[new], minlength=len(first))))
                spans = [pa.array(g.reduceat(heads[c], first), pa.int32()) for c in TRACE_FIELDS for g in (np.minimum, np.maximum)]
                inls = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inl[new], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(first)), pa.array(low), pa.array(low + traces * size), pa.array(traces, pa.int32()), *spans, inls], names=names)
                at += batch.num_rows * size


class SegyIndex(Segy):
    """Options: path; split; traces (of a block, 64)."""

    @classmethod
    def name(cls) -> str:
        return "segy_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: StructType) -> SegyIndexReader:
        return SegyIndexReader(self.options["path"], int(self.options.get("split", 64 << 20)), int(self.options.get("traces", 64)))


def register(spark: SparkSession) -> None:
    """Both sources, and filters that reach them."""
    spark.dataSource.register(Segy)
    spark.dataSource.register(SegyIndex)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_index(spark: SparkSession, path: str, index: str, traces: int = 64, split: int = 64 << 20) -> None:
    """The index of the files in path, as a Parquet table: a row for each block of `traces` traces, in their order in the file.
    It is made in one pass, task by task; files that come later are not in it."""
    register(spark)
    spark.read.format("segy_index").option("traces", traces).option("split", split).load(path).write.parquet(index)


def read_lines(spark: SparkSession, path: str, index: str, wanted: DataFrame, blocks: Column | None = None, split: int = 64 << 20) -> DataFrame:
    """The traces of path whose inl is among those of wanted (inl), from the blocks that the index knows to hold one;
    blocks: a condition on the index's rows that they must meet too. Blocks that touch are read as one; a task reads blocks
    of some `split` bytes of one file."""
    lines = wanted.select(F.col("inl").cast("int").alias("inl")).distinct()
    held = spark.read.parquet(index)
    held = held if blocks is None else held.where(blocks)
    ranges = held.select("path", "low", "high", F.explode("inls").alias("inl")).join(lines, "inl", "left_semi").select("path", "low", "high").distinct()
    ranges = ranges.repartition("path", F.floor(F.col("low") / split)).sortWithinPartitions("path", "low")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[Range]:
        last = None
        for batch in batches:
            for where, low, high in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if last and last.path == where and last.high == low:
                    last.high = high
                    continue
                if last:
                    yield last
                last = Range(where, low, high)
        if last:
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, f, where, few, held = _filesystem(path)[0], None, None, [], 0
        for r in joined(batches):
            if r.path != where:
                if f:
                    f.close()
                f, where = fs.open_input_file(r.path), r.path
            for batch in _traces(f, r.low, r.high):
                few.append(batch)
                held += batch.nbytes
                if held >= BLOCK or len(few) == 1000:
                    yield from pa.Table.from_batches(few).combine_chunks().to_batches()
                    few, held = [], 0
        if f:
            f.close()
        yield from pa.Table.from_batches(few, _ARROW).combine_chunks().to_batches()

    return ranges.mapInArrow(run, SCHEMA).join(lines, "inl", "left_semi")
