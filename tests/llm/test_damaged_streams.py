"""Transport streams that are truncated, shuffled, repeated or broken give what is sound, and never fail."""

import random

import numpy as np
import pytest

from terrane.llm import transport_stream as ts

PAYLOAD = bytes(random.Random(1).randbytes(40_000))


def packets(stream):
    return [stream[k : k + ts.PACKET] for k in range(0, len(stream), ts.PACKET)]


def test_whole_and_truncated():
    stream = ts.mux(PAYLOAD)
    whole = ts.demux(stream)
    assert whole["payload"] == PAYLOAD and (whole["cc_errors"], whole["damaged"], whole["sync_errors"]) == (0, 0, 0)
    for cut in [*range(0, 2000, 7), *range(0, len(stream), 997)]:
        got = ts.demux(stream[:cut])
        assert PAYLOAD.startswith(got["payload"]) and got["cc_errors"] == 0 and got["damaged"] <= 1
    for cut in range(2, 60):  # from the middle, tables in front
        parts = packets(stream)
        got = ts.demux(b"".join([*parts[:2], *parts[cut:]]))
        assert got["payload"] in PAYLOAD


def test_repeated_packets_and_packets_without_payload():
    rng, out, last = random.Random(2), [], None
    for p in packets(ts.mux(PAYLOAD)):
        out.append(p)
        if rng.random() < 0.3:
            out.append(p)
        if last is not None and rng.random() < 0.2:
            counter = p[3] & 15
            out.append(bytes([ts.SYNC, ts.DATA_PID >> 8, ts.DATA_PID & 255, 0x20 | counter, 183, 0]) + b"\xff" * 182)
        last = p
    got = ts.demux(b"".join(out))
    assert got["payload"] == PAYLOAD and (got["cc_errors"], got["damaged"]) == (0, 0)


def test_packets_of_open_length():
    parts = packets(ts.mux(PAYLOAD))
    for k, p in enumerate(parts):
        if k > 1 and p[1] & 0x40:
            at = p.index(b"\0\0\1\xbd")
            parts[k] = p[: at + 4] + b"\0\0" + p[at + 6 :]
    got = ts.demux(b"".join(parts))
    assert got["payload"] == PAYLOAD and got["damaged"] == 0


def test_lost_packets_and_jumps():
    parts = packets(ts.mux(PAYLOAD))
    got = ts.demux(b"".join(p for k, p in enumerate(parts) if k != 10))
    assert got["cc_errors"] == 1 and got["damaged"] == 1 and len(got["payload"]) == len(PAYLOAD) - 184
    second = next(k for k in range(4, len(parts)) if parts[k][1] & 0x40)
    jumped = bytearray(parts[second])
    jumped[5] |= 0x80
    got = ts.demux(b"".join([*parts[: second - 3], bytes(jumped), *parts[second + 1 :]]))
    assert got["cc_errors"] == 0 and got["damaged"] == 1


@pytest.mark.parametrize("seed", range(6))
def test_random_damage(seed):
    rng = np.random.default_rng(seed)
    stream = np.frombuffer(ts.mux(PAYLOAD[:9000]), np.uint8)
    for _ in range(150):
        broken = stream.copy()
        for _ in range(int(rng.integers(1, 40))):
            broken[rng.integers(len(broken))] = rng.integers(256)
        if rng.random() < 0.5:
            a, b = sorted(rng.integers(0, len(broken), 2).tolist())
            broken = np.concatenate([broken[:a], broken[b:]])
        got = ts.demux(broken.tobytes())
        assert len(got["payload"]) <= len(broken) and got["packets"] == len(broken) // ts.PACKET


def test_read_takes_anything(spark):
    rows = [(1, 3, None), (2, 0, b""), (3, 1, b"G" * 500), (4, 2, ts.mux(b"x" * 192)[:-100])]
    got = {r.doc_id: r for r in ts.read(spark.createDataFrame([(i, n, None if m is None else bytearray(m)) for i, n, m in rows], "doc_id long, n_bytes long, media binary")).collect()}
    assert [got[k].tables_ok for k in (1, 2, 3, 4)] == [False, False, False, True] and got[4].damaged == 1 and got[1].payload == b""
