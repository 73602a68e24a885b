"""The stand-in tables as bytes: one projection more, so that decoders can be checked against the columns they must give back.

Frames are built as hexadecimal text from a row's own columns and turned into bytes once; messages, whose payloads are
lists of lists, over whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.sources.headers import step
from culvert.sources.ike import PHASE_1, PHASE_2


def octets(value: str, size: int) -> str:
    """Spark SQL: a number as so many big-endian bytes, in hexadecimal; NULL stays NULL."""
    return f"lpad(hex(cast({value} as bigint)), {2 * size}, '0')"


def joined(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def size_of(hexed: str) -> str:
    return f"length({hexed}) div 2"


def octet_array(values: pa.Array, size: int) -> pa.Array:
    """Arrow: what ``octets`` gives, as bytes; of a number that is too long the first digits, as there."""
    numbers = np.asarray(values.cast(pa.int64()).fill_null(0)).copy()
    for at in np.flatnonzero((numbers < 0) | (numbers >= 1 << 8 * size)):
        numbers[at] = int(f"{int(numbers[at]) & (1 << 64) - 1:X}"[: 2 * size], 16)
    data = numbers.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].tobytes()
    plain = pa.Array.from_buffers(pa.binary(size), len(numbers), [None, pa.py_buffer(data)]).cast(pa.binary())
    return pc.if_else(values.is_valid(), plain, pa.scalar(None, pa.binary()))


def glued(*parts: pa.Array | bytes) -> pa.Array:
    """Arrow: the parts of each row side by side; NULL if one is."""
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts), pa.scalar(b"", pa.binary()), null_handling="emit_null")


def numbered(size: pa.Array, more: int, width: int) -> pa.Array:
    return octet_array(pc.add(size, more), width)


def unhexed(texts: pa.Array) -> pa.Array:
    coded = texts.dictionary_encode()
    return pa.array([bytes.fromhex(t) for t in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices)


def strung(parts: pa.Array, owner: np.ndarray, rows: int) -> pa.Array:
    """The parts of each row in order, as one value; parts that are NULL are left out. ``owner`` is sorted."""
    there = np.flatnonzero(parts.is_valid())
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner[there], minlength=rows)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts.take(pa.array(there))), b"")


MESSAGE_FIELDS = (
    "init_spi", "resp_spi", "version", "exchange", "is_response", "message_id", "payload_types", "proposal_protocol", "encr_id", "key_length", "integ_id", "prf_id",
    "dh_id", "addke_ids", "ke_group", "ke_len", "auth_id", "notify_types", "vid_hex", "nonce_len", "v1_encr", "v1_hash", "v1_auth", "v1_group", "life_type", "life_value",
    "esp_id", "esp_auth", "p2_group", "encap",
)


def _proposals(rows: dict[str, pa.Array], v1: pa.Array, size: int) -> pa.Array:
    """The proposal of each message: one transform in version 1, those that are there in version 2."""

    def attribute(tag: int, name: str) -> pa.Array:
        if name == "life_value":
            return glued(tag.to_bytes(2), b"\0\4", octet_array(rows[name], 4))
        return glued((0x8000 | tag).to_bytes(2), octet_array(rows[name], 2)).fill_null(b"")

    def transform(kind: int, number: pa.Array, attributes: pa.Array) -> pa.Array:
        return glued(b"\0", numbered(pc.binary_length(attributes), 8, 2), bytes([kind, 0]), octet_array(number, 2), attributes)

    quick = pc.equal(rows["exchange"], 32).fill_null(False)
    first, second = (glued(*(attribute(tag, name) for tag, name in phase.items())) for phase in (PHASE_1, PHASE_2))
    phase = pc.if_else(quick, second, first)
    number = pc.if_else(quick, rows["esp_id"].cast(pa.int64()), 1)
    old = glued(b"\0", numbered(pc.binary_length(phase), 8, 2), b"\1", octet_array(number, 1), b"\0\0", phase)
    none = pa.array([b""] * size, pa.binary())
    more = pc.list_flatten(rows["addke_ids"])
    parts = [transform(kind, rows[name], attribute(14, "key_length") if kind == 1 else none) for kind, name in ((1, "encr_id"), (3, "integ_id"), (2, "prf_id"), (4, "dh_id"))]
    parts.append(transform(6, more, pa.array([b""] * len(more), pa.binary())))
    owner = np.concatenate([*[np.arange(size)] * 4, np.asarray(pc.list_parent_indices(rows["addke_ids"]))])
    order = np.argsort(owner, kind="stable")
    parts, owner = pa.concat_arrays(parts).take(pa.array(order)), owner[order]
    there = np.flatnonzero(parts.is_valid())
    parts, owner = parts.take(pa.array(there)), owner[there]
    more = pc.if_else(pa.array(np.diff(owner, append=size) != 0), pa.scalar(b"\0", pa.binary()), pa.scalar(b"\3", pa.binary()))
    chained = strung(glued(more, parts), owner, size)
    chained = pc.if_else(rows["addke_ids"].is_valid(), chained, pa.scalar(None, pa.binary()))
    chained = pc.if_else(v1, glued(b"\0", old).fill_null(b""), chained)
    count = pc.if_else(v1, 1, pa.array(np.bincount(owner, minlength=size)))
    return glued(b"\0\0", numbered(pc.binary_length(chained), 8, 2), b"\1", octet_array(rows["proposal_protocol"], 1), b"\0", octet_array(count, 1), chained)


def build_messages(given: pa.StructArray) -> pa.Array:
    """The bytes of each message, all rows of a batch side by side."""
    rows, size = {name: pc.struct_field(given, name) for name in MESSAGE_FIELDS}, len(given)
    v1 = pc.equal(rows["version"], "IKEv1").fill_null(False)
    proposal = _proposals(rows, v1, size)

    def filled(letter: bytes, times: pa.Array) -> pa.Array:
        return pc.binary_repeat(pa.scalar(letter, pa.binary()), pc.max_element_wise(times.cast(pa.int64()), 0, skip_nulls=False))

    notes = rows["notify_types"]
    held = np.asarray(pc.list_value_length(notes).fill_null(0))
    starts = pa.array(np.cumsum(held) - held, mask=held == 0)
    note = pc.list_flatten(notes).take(starts).fill_null(16384)
    bodies = {
        33: proposal,
        1: glued(bytes.fromhex("0000000100000001"), proposal),
        34: glued(octet_array(rows["ke_group"].fill_null(0), 2), b"\0\0", filled(b"k", rows["ke_len"])),
        39: glued(octet_array(rows["auth_id"], 1), bytes.fromhex("0000007369")),
        41: glued(b"\0\0", octet_array(note, 2)),
        43: unhexed(rows["vid_hex"]),
        40: filled(b"n", rows["nonce_len"]),
        None: pa.array([bytes.fromhex("aabbcc")] * size, pa.binary()),
    }
    bodies[13] = bodies[43]
    kinds = np.asarray(pc.list_flatten(rows["payload_types"]).cast(pa.int64()).fill_null(0))
    owner = np.asarray(pc.list_parent_indices(rows["payload_types"])).astype(np.int64)
    slot = np.full(len(kinds), list(bodies).index(None))
    for k, kind in enumerate(bodies):
        slot[kinds == kind] = k
    body = pa.concat_arrays(list(bodies.values())).take(pa.array(slot * size + owner))
    following = np.where(np.diff(owner, append=-1) == 0, np.append(kinds[1:], 0), 0)
    framed = glued(octet_array(pa.array(following), 1), b"\0", numbered(pc.binary_length(body), 4, 2), body)
    inside = pc.if_else(rows["payload_types"].is_valid(), strung(framed, owner, size), pa.scalar(None, pa.binary()))
    first = np.zeros(size, np.int64)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    first[owner[heads]] = kinds[heads]
    flags = pc.if_else(v1, 0, pc.if_else(rows["is_response"].fill_null(False), 32, 8))
    return glued(
        unhexed(rows["init_spi"]), unhexed(rows["resp_spi"]), octet_array(pa.array(first), 1), pc.if_else(v1, pa.scalar(b"\x10", pa.binary()), pa.scalar(b"\x20", pa.binary())),
        octet_array(rows["exchange"], 1), octet_array(flags, 1), octet_array(rows["message_id"], 4), numbered(pc.binary_length(inside), 28, 4), inside,
    )


def with_messages(messages: DataFrame) -> DataFrame:
    """Adds ``ike``: the message that a row of the message stand-in stands for."""

    @F.arrow_udf("binary")
    def built(rows: pa.Array) -> pa.Array:
        return build_messages(rows)

    return step(messages, ike=built(F.struct(*MESSAGE_FIELDS)))


def address(column: str) -> str:
    return f"array_join(transform(split({column}, '[.]'), x -> {octets('x', 1)}), '')"


def with_frames(packets: DataFrame) -> DataFrame:
    """Adds ``data``: the Ethernet frame of a row of the packet stand-in, ``size`` bytes long. A row without an SPI has too short a body."""
    body = joined("if(proto = 51, '32040000', '')", octets("spi", 4), octets("seq", 4))
    rows = step(packets, _b=F.expr(f"coalesce({body}, 'ab')"))
    frame = joined("repeat('02', 12)", "'08004500'", octets(f"20 + {size_of('_b')}", 2), "'0000000040'", octets("proto", 1), "'0000'", address("src"), address("dst"), "_b")
    return step(rows, data=F.expr(f"unhex(rpad({frame}, cast(size as int) * 2, '0'))")).drop("_b")


#: classic capture header: little-endian, microseconds, Ethernet
PCAP_HEADER = "d4c3b2a1020004000000000000000000ffff000001000000"


def little(value: str) -> str:
    """Spark SQL: four little-endian bytes in hexadecimal."""
    big = octets(value, 4)
    return f"concat(substr({big}, 7, 2), substr({big}, 5, 2), substr({big}, 3, 2), substr({big}, 1, 2))"


def write_captures(frames: DataFrame, path: str) -> None:
    """One capture file of each partition, through Spark's text sink.

    The sink ends each row with a line feed, so every record gives up its last byte, which is set to one, to it.
    """
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    record = F.expr(f"concat({little('t_us div 1000000')}, {little('t_us % 1000000')}, {little('size')}, {little('size')}, substr(hex(data), 1, cast(size as int) * 2 - 2))")
    hexed = F.concat(F.when(first, PCAP_HEADER).otherwise(""), record)
    frames.select(F.unhex(hexed).cast("string").alias("value")).write.text(path)
