"""Capture files as a packet table.

Python only cuts a file into records (frame, time, link type, bytes); everything above that, link
layer, IP, UDP, SPI and key-exchange header, is decoded with Column expressions in
``sources.headers``.

``read_captures`` (of ``sources.splits``) scans byte ranges of a file side by side, on any path that Spark reads.
``PcapSource`` (format ``pcap``) streams each file from a mounted path.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from culvert.sources.splits import CLASSIC_MAGIC, MAGICS, MOST, NG_MAGIC, RECORD_DDL, read_captures, ticks_per_second

__all__ = ["PcapSource", "read_captures", "records", "rejected_captures", "sniff"]


def records(stream: BinaryIO) -> Iterator[tuple[int, int, int, bytes]]:
    """(frame, microseconds, link type, bytes) of each packet; a cut-off tail ends the file."""
    magic = stream.read(4)
    if magic.hex() == NG_MAGIC:
        yield from _ng_records(stream)
    elif magic.hex() in CLASSIC_MAGIC:
        order, per_us = CLASSIC_MAGIC[magic.hex()]
        head = stream.read(20)
        if len(head) < 20:
            return
        link = struct.unpack(order + "I", head[16:20])[0] & 0x0FFFFFFF
        frame = 0
        while len(rec := stream.read(16)) == 16:
            sec, sub, kept, _ = struct.unpack(order + "IIII", rec)
            data = stream.read(kept) if kept <= MOST else b""
            if len(data) < kept:
                return
            frame += 1
            yield frame, sec * 1_000_000 + sub // per_us, link, data


def _ng_records(stream: BinaryIO) -> Iterator[tuple[int, int, int, bytes]]:
    order, links, frame = "<", [], 0
    kind = bytes.fromhex(NG_MAGIC)
    while len(kind) == 4:
        raw_len = stream.read(4)
        if len(raw_len) < 4:
            return
        if kind.hex() == NG_MAGIC:  # section header: its third word tells the byte order
            bom = stream.read(4)
            order = "<" if bom.hex() == "4d3c2b1a" else ">"
            size, links = struct.unpack(order + "I", raw_len)[0], []
            stream.read(size - 12)
            kind = stream.read(4)
            continue
        size = struct.unpack(order + "I", raw_len)[0]
        body = stream.read(size - 8) if 12 <= size <= MOST + 512 and size % 4 == 0 else b""
        if len(body) < size - 8:
            return
        body = body[: size - 12]
        code = struct.unpack(order + "I", kind)[0]
        if code == 1 and len(body) >= 8:
            links.append((struct.unpack(order + "H", body[:2])[0], ticks_per_second(order, body[8:])))
        elif code == 6 and len(body) >= 20:
            iface, hi, lo, kept, _ = struct.unpack(order + "IIIII", body[:20])
            link, ticks = links[iface] if iface < len(links) else (1, 1_000_000)
            frame += 1
            yield frame, ((hi << 32) | lo) * 1_000_000 // ticks, link, body[20 : 20 + kept]
        elif code == 3 and len(body) >= 4:
            frame += 1
            yield frame, 0, links[0][0] if links else 1, body[4 : 4 + struct.unpack(order + "I", body[:4])[0]]
        kind = stream.read(4)


def sniff(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Add ``verdict`` to binaryFile rows: ``ok``, ``not a capture``, or ``too large`` for a given cap."""
    magic = F.lower(F.hex(F.substring("content", 1, 4)))
    return files.withColumn(
        "verdict", F.when(F.lit(False) if cap is None else F.col("length") > cap, "too large").when(magic.isin(*MAGICS), "ok").otherwise("not a capture")
    )


def rejected_captures(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return sniff(files, cap).filter("verdict <> 'ok'").select("path", "length", "verdict")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found if os.path.isfile(p)]

    def read(self, partition):
        with open(partition.path, "rb") as stream:
            for record in records(stream):
                yield (os.path.basename(partition.path), *record)


class PcapSource(DataSource):
    """``spark.dataSource.register(PcapSource)`` then ``spark.read.format("pcap").load(path)``."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return RECORD_DDL

    def reader(self, schema):
        return _Reader(self.options["path"])
