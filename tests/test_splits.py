"""Captures cut into byte ranges give the rows of the sequential reader, for any split and window size."""

import io
import random
import struct

import pytest
import wire as w

from culvert.sources import pcap, splits


def frames(rng, n):
    """Payloads full of bytes that look like record headers, line feeds and zeros."""
    fake = struct.pack("<IIII", 1_700_000_000, 5, 40, 40)
    pieces = [fake, b"\n", b"\0" * 40, b"x" * 30, b"\r\n", struct.pack("<II", 6, 44)]
    return [b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def block(order, code, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", code) + size + body + size


def sections(rng, n):
    """Sections of both byte orders, with interfaces of several clocks and links, simple and other blocks."""
    out = b""
    for order in "<><":
        out += block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        for link, unit in ((1, 6), (101, 9), (113, 0x80 | 10)):
            out += block(order, 1, struct.pack(order + "HHIHHB", link, 0, 65535, 9, 1, unit) + b"\0\0\0" + struct.pack(order + "HH", 0, 0))
        for k, data in enumerate(frames(rng, n)):
            us = 1_700_000_000_000_000 + k
            out += block(order, 6, struct.pack(order + "IIIII", k % 3, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data)
            if k % 5 == 0:
                out += block(order, 3, struct.pack(order + "I", len(data)) + data)
            if k % 7 == 0:
                out += block(order, 4, b"names")
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(2)
    plain = w.pcap(frames(rng, 300))
    big = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 101)
    for k, f in enumerate(frames(rng, 60)):
        big += struct.pack(">IIII", 1_700_000_000, k * 1000, len(f), len(f) + 5) + f
    impossible = plain[:4000] + struct.pack("<IIII", 1, 1, splits.MOST + 1, splits.MOST + 1) + b"z" * 500
    return {
        "plain.pcap": plain, "cut.pcap": plain[:-9], "nano.pcap": w.pcap(frames(rng, 50), nano=True), "big.pcap": big, "ng.pcapng": w.pcapng(frames(rng, 120)),
        "sections.pcapng": sections(rng, 40), "cut.pcapng": sections(rng, 20)[:-17], "empty.pcap": b"", "head.pcap": plain[:24], "short.pcap": plain[:11],
        "other.txt": b"no capture\n" * 50, "zeros.pcap": w.pcap([b"\0" * 90] * 40), "long.pcap": w.pcap([b"\n" * 3000, b"q" * 2500, b"last"]), "wrong.pcap": impossible,
    }


def sequential(files):
    return sorted((name, *r) for name, content in files.items() for r in pcap.records(io.BytesIO(content)))


@pytest.mark.parametrize(("split", "window"), [("128m", splits.WINDOW), ("2000b", 5000)])
def test_equals_the_sequential_reader(spark, tmp_path, files, split, window):
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = splits.read_captures(spark, f"file://{tmp_path}", window=window, beyond=6000 if window < 6000 else splits.BEYOND)
        got = sorted((r["capture_id"], r["frame"], r["t_us"], r["link"], bytes(r["data"])) for r in found.collect())
        if split == "2000b":
            held = splits.windows(spark, f"file://{tmp_path}/plain.pcap", window, 6000)
            assert held.count() == -(-len(files["plain.pcap"]) // window), "one file is many windows"
            assert b"".join(bytes(r["data"])[:window] for r in held.orderBy("window").collect()) == files["plain.pcap"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sequential(files)


def test_cap(spark, tmp_path, files):
    for name in ("plain.pcap", "big.pcap"):
        (tmp_path / name).write_bytes(files[name])
    cap = len(files["big.pcap"])
    assert {r["capture_id"] for r in splits.read_captures(spark, str(tmp_path), cap).collect()} == {"big.pcap"}
