"""Capture files of any size as a packet table, in byte ranges that are scanned side by side.

Spark's text source deals a file out in splits at some byte; its rows, each with its line end, are the file's bytes in
order, so sums per split give every byte its offset. The bytes are put into windows of equal size (each with as much of the next
as a record may reach into it). A window guesses its first record: the first offset from which headers chain through
the window. Where the record before it really ends settles that: a window whose guess differs from the end of its left neighbour is
scanned again from there, until all agree. Records then get their numbers from the counts of the windows before.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.session import materialise

# First four bytes of capture files, as hex; sizes of headers; the largest snapshot length of a capture.
CLASSIC_MAGIC = {"d4c3b2a1": ("<", 1), "a1b2c3d4": (">", 1), "4d3cb2a1": ("<", 1000), "a1b23c4d": (">", 1000)}
NG_MAGIC = "0a0d0d0a"
MAGICS = (*CLASSIC_MAGIC, NG_MAGIC)
FILE_HEADER, RECORD_HEADER, LEAST_BLOCK = 24, 16, 12
MOST = 262_144
INTERFACE, SIMPLE, ENHANCED = 1, 3, 6

RECORD_DDL = "capture_id string, frame bigint, t_us bigint, link int, data binary"
#: bytes of a window, and of what it sees of the next one: a whole record with its header
WINDOW, BEYOND = 4 << 20, MOST + 1024
#: stored windows of a file: Parquet's writer and reader hold a hundred rows and more of a file at a time, whatever their size
WINDOWS_A_FILE = 4
NONE = -1


@dataclass
class Format:
    """What a record scan has to know of the file so far. Sections of the block format name their interfaces anew."""

    magic: str
    order: str
    per_us: int = 1
    link: int = 1
    links: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, head: bytes) -> Format | None:
        magic = head[:4].hex()
        if magic == NG_MAGIC:
            return cls(magic, "<" if head[8:12].hex() == "4d3c2b1a" else ">")
        if magic in CLASSIC_MAGIC and len(head) >= FILE_HEADER:
            order, per_us = CLASSIC_MAGIC[magic]
            return cls(magic, order, per_us, struct.unpack_from(order + "I", head, 20)[0] & 0x0FFFFFFF)
        return None

    @property
    def blocks(self) -> bool:
        return self.magic == NG_MAGIC

    @property
    def begin(self) -> int:
        return 0 if self.blocks else FILE_HEADER


def span(data: bytes, at: int, form: Format) -> int:
    """Bytes of the record or block at an offset of ``data``, which holds its header; ``NONE`` if its length can't be."""
    if not form.blocks:
        kept = struct.unpack_from(form.order + "I", data, at + 8)[0]
        return RECORD_HEADER + kept if kept <= MOST else NONE
    order = form.order
    if data[at : at + 4].hex() == NG_MAGIC:
        order = "<" if data[at + 8 : at + 12].hex() == "4d3c2b1a" else ">"
    size = struct.unpack_from(order + "I", data, at + 4)[0]
    return size if LEAST_BLOCK <= size <= MOST + 512 and size % 4 == 0 else NONE


def ticks_per_second(order: str, options: bytes) -> int:
    while len(options) >= 4:
        code, size = struct.unpack_from(order + "HH", options)
        if code == 9 and size:
            unit = options[4]
            return 2 ** (unit & 0x7F) if unit & 0x80 else 10**unit
        if code == 0:
            break
        options = options[4 + size + (-size) % 4 :]
    return 1_000_000


def read_one(data: bytes, at: int, size: int, form: Format) -> tuple[int, int, bytes] | None:
    """Microseconds, link type and bytes of the record at an offset; None for a block without one, which may change ``form``."""
    order = form.order
    if not form.blocks:
        sec, sub = struct.unpack_from(order + "II", data, at)
        return sec * 1_000_000 + sub // form.per_us, form.link, data[at + RECORD_HEADER : at + size]
    if data[at : at + 4].hex() == NG_MAGIC:
        form.order, form.links = "<" if data[at + 8 : at + 12].hex() == "4d3c2b1a" else ">", []
        return None
    code, body = struct.unpack_from(order + "I", data, at)[0], data[at + 8 : at + size - 4]
    if code == INTERFACE and len(body) >= 8:
        form.links.append((struct.unpack_from(order + "H", body)[0], ticks_per_second(order, body[8:])))
    elif code == ENHANCED and len(body) >= 20:
        place, high, low, kept = struct.unpack_from(order + "IIII", body)
        link, ticks = form.links[place] if place < len(form.links) else (1, 1_000_000)
        return ((high << 32) | low) * 1_000_000 // ticks, link, body[20 : 20 + kept]
    elif code == SIMPLE and len(body) >= 4:
        return 0, form.links[0][0] if form.links else 1, body[4 : 4 + struct.unpack_from(order + "I", body)[0]]
    return None


def chain(data: bytes, at: int, stop: int, last: int, form: Format) -> Iterator[tuple[int, int]]:
    """Offset and size of each whole record from ``at`` on that begins before ``stop``; then (where the next one begins or ``NONE``, 0).

    ``last`` is the offset of the file's end: a record that it cuts off, or one of an impossible length, ends the file.
    """
    head = LEAST_BLOCK if form.blocks else RECORD_HEADER
    while at < stop:
        size = span(data, at, form) if at + head <= last else NONE
        if size == NONE or at + size > last:
            at = NONE
            break
        yield at, size
        at += size
    yield at, 0


def guess(data: bytes, stop: int, last: int, form: Format) -> int:
    """The first offset of a window from which records chain through it, or ``NONE``."""
    raw = np.frombuffer(data, np.uint8)
    head = LEAST_BLOCK if form.blocks else RECORD_HEADER
    room = min(len(raw) - head, stop, BEYOND)
    if room <= 0:
        return NONE

    def word(at: np.ndarray, order: str) -> np.ndarray:
        weights = range(4) if order == "<" else range(3, -1, -1)
        return sum(raw[at + k].astype(np.int64) << 8 * w for k, w in enumerate(weights))

    if form.blocks:
        at = np.arange(0, room, 4)
        size = word(at + 4, form.order)
        at, size = (x[(size >= LEAST_BLOCK) & (size <= MOST + 512) & (size % 4 == 0) & (at + size <= len(raw))] for x in (at, size))
        at = at[word(at + size - 4, form.order) == size]
    else:
        at = np.arange(room)
        kept, sent = word(at + 8, form.order), word(at + 12, form.order)
        at = at[(word(at + 4, form.order) < 1_000_000 * form.per_us) & (kept > 0) & (kept <= MOST) & (kept <= sent)]
    for begin in at.tolist():
        *_, (end, _) = chain(data, begin, stop, last, form)
        if end >= stop or end == NONE and stop >= last:
            return begin
    return NONE


def _assemble(window: int, beyond: int) -> Callable[[pa.Table], pa.Table]:
    def whole(pieces):
        order = np.argsort(pieces.column("offset").to_numpy())
        parts = [pieces.column("piece")[int(k)].as_py() for k in order]
        size = pieces.column("size")[0].as_py()
        at = pieces.column("window")[0].as_py()
        data = b"".join(parts)[: min(window + beyond, size - at * window)]
        return pa.table({"path": pa.array([pieces.column("path")[0].as_py()]), "window": pa.array([at], pa.int64()), "size": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

    return whole


def windows(spark: SparkSession, path: str, window: int, beyond: int) -> DataFrame:
    """path, window (its number), size (of the file), data: the bytes of all files below ``path``, stored."""
    # a batch of windows is cut by its bytes; by its rows it would hold thousands of them
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(WINDOW))
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.unhex(F.lit("0A"))).alias("piece"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.sum(F.length("piece")).alias("held"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a split as pieces of up to a window, with their offset in the split."""
        own, held, offset = None, [], 0

        def close():
            names = ["path", "size", "block", "inside", "piece"]
            return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]], pa.int64()), pa.array([own[2]], pa.int64()), pa.array([offset], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=names)

        full = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "block", "piece")), strict=True):
                if own != row[:3]:
                    if held:
                        yield close()
                    own, held, full, offset = row[:3], [], 0, 0
                held.append(row[3])
                full += len(row[3])
                if full >= window:
                    yield close()
                    held, full, offset = [], 0, offset + full
        if held:
            yield close()

    pieces = lines.mapInArrow(packed, "path string, size long, block long, inside long, piece binary").join(blocks, ["path", "block"])
    pieces = pieces.withColumn("offset", F.col("base") + F.col("inside")).filter(F.col("offset") < F.col("size"))
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - beyond) / window)).cast("long")
    last = F.floor((F.col("offset") + F.length("piece") - 1) / window).cast("long")
    dealt = pieces.select("path", "size", "offset", "piece", F.explode(F.sequence(first, last)).alias("window"))
    begin = F.greatest(F.col("offset"), F.col("window") * window)
    end = F.least(F.col("offset") + F.length("piece"), F.col("window") * window + window + beyond)
    dealt = dealt.select("path", "size", "window", begin.alias("offset"), F.substr("piece", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int")).alias("piece")).filter(F.length("piece") > 0)
    whole = dealt.groupBy("path", "window").applyInArrow(_assemble(window, beyond), "path string, window long, size long, data binary")
    return materialise(whole.filter(F.col("window") * window < F.col("size")), "capture-windows", WINDOWS_A_FILE)


EVENT = pa.list_(pa.struct([("at", pa.int64()), ("order", pa.string()), ("link", pa.int64()), ("ticks", pa.int64())]))
EVENT_DDL = "array<struct<at: long, order: string, link: long, ticks: long>>"


def _scanned(batches: Iterator[pa.RecordBatch], window: int, told: bool) -> Iterator[pa.RecordBatch]:
    """path, window, start, next, records, events of each window: from the start it is told, else from its own guess."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            form, base, data = Format.of(row["head"]), row["window"] * window, row["data"]
            last, stop = row["size"] - base, min(window, row["size"] - base)
            if row["order"]:
                form.order = row["order"]
            start = row["start"] - base if told else form.begin if base == 0 else guess(data, stop, last, form)
            count, events, begin = 0, [], start
            if start != NONE:
                for at, size in chain(data, start, stop, last, form):
                    if not size:
                        begin = NONE if at == NONE or at >= last else at + base
                        break
                    known = len(form.links)
                    count += read_one(data, at, size, form) is not None
                    if len(form.links) > known:
                        events.append({"at": at + base, "order": form.order, "link": form.links[-1][0], "ticks": form.links[-1][1]})
                    elif form.blocks and not form.links and data[at : at + 4].hex() == NG_MAGIC:
                        events.append({"at": at + base, "order": form.order, "link": None, "ticks": None})
            out.append((row["path"], row["window"], NONE if start == NONE else start + base, begin, count, events))
        path, number, start, following, count, events = zip(*out, strict=True) if out else ((),) * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), *(pa.array(c, pa.int64()) for c in (number, start, following, count)), pa.array(events, EVENT)],
            names=["path", "window", "start", "next", "records", "events"],
        )


SCANNED = f"path string, window long, start long, next long, records long, events {EVENT_DDL}"


def _read(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["capture_id", "frame", "t_us", "link", "data"]
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            form, base, data = Format.of(row["head"]), row["window"] * window, row["data"]
            for event in row["before"] or []:
                form.order = event["order"]
                form.links = [] if event["link"] is None else [*form.links, (event["link"], event["ticks"])]
            last, frame, found = row["size"] - base, row["frame"], []
            for at, size in chain(data, row["start"] - base, min(window, last), last, form):
                if size and (one := read_one(data, at, size, form)):
                    frame += 1
                    found.append((frame, *one))
            if found:
                columns = list(zip(*found, strict=True))
                arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"].rsplit("/", 1)[-1]] * len(found)), *arrays], names=names)


def read_captures(spark: SparkSession, path: str, cap: int | None = None, window: int = WINDOW, beyond: int = BEYOND) -> DataFrame:
    """Raw packet records of every capture below ``path`` (not above ``cap`` bytes, if given); ``capture_id`` is the file name.

    Any path that Spark reads will do, and files may have any size. Files that are no captures, and empty ones, have no
    records. A record that the file's end cuts off, or one longer than a capture can hold, ends its file.
    """
    held = windows(spark, path, window, beyond)
    if cap is not None:
        held = held.filter(F.col("size") <= cap)
    heads = held.filter("window = 0").select("path", F.substring("data", 1, FILE_HEADER).alias("head"))
    magic = F.lower(F.hex(F.substring("head", 1, 4)))
    heads = heads.filter(magic.isin(*MAGICS) & ((magic == NG_MAGIC) | (F.length("head") == FILE_HEADER)))
    held = held.join(F.broadcast(heads), "path")  # one row of a file; all windows of a file would meet in one task

    def scan(rows: DataFrame, told: bool) -> DataFrame:
        return materialise(rows.mapInArrow(lambda batches: _scanned(batches, window, told), SCANNED), "capture-scan")

    known = scan(held.select("path", "window", "size", "data", "head", F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("order")), False)
    by_file = W.partitionBy("path")
    while True:
        # a window is settled if it begins where its left neighbour ends; behind the first end of a file nothing counts
        told = known.withColumn("due", F.when(F.col("window") == 0, F.col("start")).otherwise(F.lag("next").over(by_file.orderBy("window"))))
        ends = F.min(F.when((F.col("next") == NONE) & (F.col("start") == F.col("due")), F.col("window"))).over(by_file)
        order = F.last(F.get(F.col("events.order"), F.size("events") - 1), True).over(by_file.orderBy("window").rowsBetween(W.unboundedPreceding, -1))
        told = told.withColumn("end", ends).withColumn("order", order)
        wrong = told.filter((F.col("start") != F.col("due")) & (F.col("due") != NONE) & (F.col("end").isNull() | (F.col("window") <= F.col("end"))))
        wrong = materialise(wrong.select("path", "window", F.col("due").alias("start"), "order"), "capture-disputes")
        if wrong.isEmpty():
            break
        again = scan(held.join(wrong, ["path", "window"]).select("path", "window", "size", "data", "head", "start", "order"), True)
        known = materialise(known.join(again, ["path", "window"], "left_anti").unionByName(again), "capture-scan")
    earlier = by_file.orderBy("window").rowsBetween(W.unboundedPreceding, -1)
    settled = told.filter((F.col("start") == F.col("due")) & (F.col("start") != NONE) & (F.col("end").isNull() | (F.col("window") <= F.col("end"))))
    settled = settled.select("path", "window", "start", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("frame"), F.flatten(F.collect_list("events").over(earlier)).alias("before"))
    return held.join(settled, ["path", "window"]).mapInArrow(lambda batches: _read(batches, window), RECORD_DDL)
