"""Media columns as MPEG transport streams: payloads are stored in packets and read back with tables, clocks and checks."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
TICKS = 90_000
#: Payload bytes of one elementary packet, ticks between two, and how many apart random-access points are.
UNIT, UNIT_TICKS, KEY_EVERY = 3072, 3600, 4


@functools.lru_cache(4096)
def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


@functools.cache
def _tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
    return b"".join((struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + s).ljust(PACKET, bytes([STUFFING])) for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))


def _stamp(ticks: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (ticks >> 29 & 0x0E), (ticks >> 14 & 0xFFFE) | 1, (ticks << 1 & 0xFFFE) | 1)


def mux(payload: bytes) -> bytes:
    """A transport stream: program tables, then the payload in elementary packets with time stamps; every KEY_EVERY-th is a
    random-access point."""
    out, counter = [_tables()], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        body, ticks = payload[at : at + UNIT], unit * UNIT_TICKS & (1 << 33) - 1
        packet = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(body) + 8, 0x84, 0x80, 5) + _stamp(ticks) + body
        clock = struct.pack(">BIH", 0x10 | (0x40 if unit % KEY_EVERY == 0 else 0), ticks >> 1, (ticks & 1) << 15 | 0x7E00)
        begin, field = 0, clock
        while begin < len(packet):
            room = PACKET - 4 - (1 + len(field) if field else 0)
            part = packet[begin : begin + room]
            if len(part) < room:
                spare = room - len(part)
                field = field.ljust(len(field) + spare, bytes([STUFFING])) if field else (b"\0" + bytes([STUFFING]) * (spare - 2) if spare > 1 else b"")
                adapted = True
            else:
                adapted = bool(field)
            head = struct.pack(">BHB", SYNC, (0x4000 if begin == 0 else 0) | DATA_PID, (0x30 if adapted else 0x10) | counter)
            out.append(head + (bytes([len(field)]) + field if adapted else b"") + part)
            counter, begin, field = counter + 1 & 15, begin + len(part), b""
    return b"".join(out)


def _read_section(packet: bytes) -> tuple[int, int, bytes] | None:
    """(table, extension, body) of the section that a packet holds; None if its sum is wrong or it is not whole."""
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    start = at + 1 + packet[at] if at < PACKET else PACKET
    if start + 3 > PACKET:
        return None
    length = struct.unpack_from(">H", packet, start + 1)[0] & 0x0FFF
    whole = packet[start : start + 3 + length]
    if len(whole) < 12 or section_crc(whole[:-4]) != struct.unpack(">I", whole[-4:])[0]:
        return None
    return whole[0], struct.unpack_from(">H", whole, 3)[0], whole[8:-4]


def demux(media: bytes) -> dict:
    """What a stream holds: payload, packets, tables found sound, elementary packets with their time stamps and places, which
    of them are random-access points, continuity errors (counters that don't follow), and packets without the sync byte.

    Damaged streams give what is sound. The first sound section of each table counts. A packet that is sent twice counts
    once; one without payload, or that announces a jump, is no continuity error. An elementary packet without a whole header
    is left out, of one that is cut short what is there is kept, both are `damaged`; one of length 0 goes on to the next. What
    comes before the first elementary packet, and a last packet that is not whole, are left out."""
    found = {"payload": b"", "packets": len(media) // PACKET, "tables_ok": False, "program": None, "stream_type": None, "cc_errors": 0, "sync_errors": 0, "points": [], "damaged": 0}
    grid = np.frombuffer(media, np.uint8)[: found["packets"] * PACKET].reshape(-1, PACKET)
    good = grid[:, 0] == SYNC
    found["sync_errors"] = int((~good).sum())
    pid = (grid[:, 1] & 0x1F).astype(np.int32) << 8 | grid[:, 2]
    pid[~good] = 0x1FFF


    def section(of: int, sound) -> tuple[int, int, bytes] | None:
        got = (_read_section(grid[k].tobytes()) for k in np.flatnonzero(pid == of).tolist())
        return next((s for s in got if s and sound(s)), None)

    pat = section(PAT_PID, lambda s: s[0] == 0 and len(s[2]) >= 4)
    if pat is None:
        return found
    found["program"], pmt_pid = struct.unpack(">HH", pat[2][:4])
    pmt = section(pmt_pid & 0x1FFF, lambda s: s[0] == 2 and s[1] == found["program"] and len(s[2]) >= 9)
    skip = 4 + (struct.unpack_from(">H", pmt[2], 2)[0] & 0x0FFF) if pmt else 0
    if pmt is None or skip + 3 > len(pmt[2]):
        return found
    found["stream_type"], data_pid = struct.unpack_from(">BH", pmt[2], skip)
    found["tables_ok"] = True
    rows = grid[pid == (data_pid & 0x1FFF)]
    rows = rows[(rows[:, 3] & 0x10) > 0]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:] == rows[:-1]).all(1)
    rows = rows[~again]
    counters, adapted = rows[:, 3] & 15, (rows[:, 3] & 0x20) > 0
    jump = adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x80) > 0)
    found["cc_errors"] = int(((((counters[:-1] + 1) & 15) != counters[1:]) & ~jump[1:]).sum())
    start = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    opens, keyed = (rows[:, 1] & 0x40) > 0, adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) > 0)
    flat, first = rows.tobytes(), np.flatnonzero(opens).tolist()
    done, parts = 0, []
    for a, b in zip(first, [*first[1:], len(rows)][: len(first)], strict=True):
        packet = b"".join([flat[k * PACKET + s : (k + 1) * PACKET] for k, s in zip(range(a, b), start[a:b].tolist(), strict=True)])
        if len(packet) < 9 or packet[:3] != b"\0\0\1" or len(packet) < 9 + packet[8]:
            found["damaged"] += 1
            continue
        _, length, _, flags, extra = struct.unpack_from(">IHBBB", packet)
        pts = None
        if flags & 0x80 and extra >= 5:
            x, y, z = struct.unpack_from(">BHH", packet, 9)
            pts = (x & 0x0E) << 29 | (y & 0xFFFE) << 14 | z >> 1
        found["damaged"] += bool(length and len(packet) < 6 + length)
        body = packet[9 + extra : 6 + length] if length else packet[9 + extra :]
        found["points"].append((pts, done, bool(keyed[a])))
        parts.append(body)
        done += len(body)
    found["payload"] = b"".join(parts)
    return found


def store(docs: DataFrame, block: int = 192) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded with spaces to a positive multiple of `block`, as a stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data = [(x.as_py() or "").encode() for x in part.column(1)]
                media = [mux(d.ljust(max(block, -(-len(d) // block) * block), b" ")) for d in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.large_binary())], schema=schema).cast(pa.schema([*list(schema)[:2], ("media", pa.binary())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = (
    "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, program int, stream_type int, packets long, "
    "tables_ok boolean, cc_errors long, sync_errors long, points array<struct<pts:long,place:long,random_access:boolean>>, damaged long"
)


def read(stored: DataFrame) -> DataFrame:
    """The streams of a `media` column, demultiplexed (see demux): payload, tables, errors and the points of access. A null
    stream is an empty one."""
    point = pa.struct([("pts", pa.int64()), ("place", pa.int64()), ("random_access", pa.bool_())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(point), pa.int64()]
    schema = pa.schema([(part.split()[0], kind) for part, kind in zip(READ.replace(",pl", "_pl").replace(",ra", "_ra").split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for media in part.column(2):
                    media = media.as_py() or b""
                    f = demux(media)
                    points = [dict(zip(("pts", "place", "random_access"), p, strict=True)) for p in f["points"]]
                    rows.append((f["payload"], len(media), hashlib.sha256(media).hexdigest(), f["program"], f["stream_type"], f["packets"], f["tables_ok"], f["cc_errors"], f["sync_errors"], points, f["damaged"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[2:], strict=True))], schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def media_features(docs: DataFrame, block: int = 192) -> DataFrame:
    """Every text stored as a transport stream and read back: digests of both forms, and what the stream says of itself.

    Returns doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of its last 16 bytes) as read back,
    media_bytes, media_sha256, feature ("program/stream type, packets, elementary packets, random-access points, last time
    stamp in ticks, errors"), and cc_errors. A null text is empty (one block of spaces); repeated rows and null ids are rows
    like others; an empty table gives no rows; other columns are ignored.
    """
    points = F.col("points")
    keys = F.size(F.filter(points, lambda p: p["random_access"]))
    feature = F.format_string("program=%d/%d;packets=%d;pes=%d;rap=%d;last_pts=%d;errors=%d", "program", "stream_type", "packets", F.size(points), keys, F.element_at(points, -1)["pts"], F.col("cc_errors") + F.col("sync_errors"))
    crc = F.crc32(F.substring("payload", -16, 16))
    return read(store(docs, block)).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), crc.alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"), "cc_errors",
    )
