"""Link, IP, UDP and key-exchange headers as Column expressions over a packet's bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protocol numbers, ports and header sizes.
ESP, AH, UDP = 50, 51, 17
FRAGMENT = 44
EXTENSIONS = (0, 43, FRAGMENT, 60)
IKE_PORT, NAT_PORT = 500, 4500
IKE_HEADER = 28
V1, V2 = 0x10, 0x20
FLAG_RESPONSE, FLAG_V1_ENCRYPTED = 0x20, 0x01


def number(data: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned integer at a byte offset; NULL when the bytes are not there."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substr(data, (at + 1).cast("int"), F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def rest(data: Column, offset: Column, size: Column | None = None) -> Column:
    start = (offset + 1).cast("int")
    width = F.length(data) if size is None else F.greatest(size, F.lit(0)).cast("int")
    return F.substr(data, start, width)


def _network_start(link: Column, data: Column) -> Column:
    """Offset of the IP header, NULL for anything else on the link."""
    ip_types = (0x0800, 0x86DD)
    tags = (0x8100, 0x88A8)
    t0, t1, t2 = number(data, 12, 2), number(data, 16, 2), number(data, 20, 2)
    ethernet = (
        F.when(t0.isin(*ip_types), 14)
        .when(t0.isin(*tags) & t1.isin(*ip_types), 18)
        .when(t0.isin(*tags) & t1.isin(*tags) & t2.isin(*ip_types), 22)
    )
    return (
        F.when(link == 1, ethernet)
        .when(link.isin(12, 14, 101, 228, 229), 0)
        .when(link.isin(0, 108), 4)
        .when(link == 113, F.when(number(data, 14, 2).isin(*ip_types), 16))
        .when(link == 276, F.when(number(data, 0, 2).isin(*ip_types), 20))
    )


def ipv4_text(data: Column, offset: Column) -> Column:
    return F.concat_ws(".", *[number(data, offset + i, 1).cast("string") for i in range(4)])


def ipv6_groups(data: Column, offset: Column) -> Column:
    """The eight groups between colons, each without leading zeros: ``:2001:db8:0:...:1:``."""
    groups = [F.lower(F.conv(number(data, offset + 2 * i, 2).cast("string"), 10, 16)) for i in range(8)]
    return F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":"))


def ipv6_text(whole: Column) -> Column:
    """Shortest form: the longest run of zero groups is written as ``::``."""
    out = None
    for run in range(8, 1, -1):
        zeros = ":" + "0:" * run
        at = F.locate(zeros, whole)
        short = F.concat(F.substr(whole, F.lit(1), at - 1), F.lit("::"), F.substr(whole, at + len(zeros)))
        out = F.when(at > 0, short) if out is None else out.when(at > 0, short)
    text = F.regexp_replace(out.otherwise(whole), "^:(?!:)", "")
    return F.regexp_replace(text, "(?<!:):$", "")


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator.

    Plain projections would be merged and later filters pushed through them, which repeats every
    byte expression at each use; a generator's output stays a plain attribute.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def behind_extensions(proto: Column, body: Column) -> Column:
    """(proto, at, fragment) of what an IPv6 packet carries behind its extension headers, however many there are.

    Every such header is a multiple of 8 bytes, so the body's length bounds the steps.
    """
    steps = F.when(proto.isin(*EXTENSIONS), F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(body) / 8).cast("int")))).otherwise(F.array().cast("array<int>"))

    def over(s: Column, _: Column) -> Column:
        kind, at = s["proto"], s["at"]
        following, words = number(body, at, 1).cast("int"), number(body, at + 1, 1)
        size = F.when(kind == FRAGMENT, 8).otherwise((words + 1) * 8).cast("int")
        offset = F.when(kind == FRAGMENT, F.shiftright(number(body, at + 2, 2), 3)).otherwise(0).cast("int")
        whole = kind.isin(*EXTENSIONS) & (s["fragment"] == 0) & size.isNotNull() & offset.isNotNull() & (F.length(body) >= at + size)
        return F.when(whole, F.struct(following.alias("proto"), (at + size).alias("at"), offset.alias("fragment"))).otherwise(s)

    return F.aggregate(steps, F.struct(proto.cast("int").alias("proto"), F.lit(0).alias("at"), F.lit(0).alias("fragment")), over)


def decode_headers(raw: DataFrame) -> DataFrame:
    """Addresses, transport protocol and transport body of each packet; non-IP packets drop out."""
    data, ip = F.col("data"), F.col("_ip")
    df = step(raw, _ip=_network_start(F.col("link"), data)).filter("_ip IS NOT NULL")
    first = number(data, ip, 1)
    df = step(df, _v=F.shiftright(first, 4), _head=first.bitwiseAND(15) * 4, _t4=number(data, ip + 2, 2), _t6=number(data, ip + 4, 2))
    v4, v6, head = F.col("_v") == 4, F.col("_v") == 6, F.col("_head")
    whole = F.when(v4, F.length(data) >= ip + 20).when(v6, F.length(data) >= ip + 40).otherwise(F.lit(False))
    df = df.filter(whole)
    body4 = rest(data, ip + head, F.when(F.col("_t4") > head, F.col("_t4") - head).otherwise(F.length(data)))
    body6 = rest(data, ip + 40, F.when(F.col("_t6") > 0, F.col("_t6")).otherwise(F.length(data)))
    df = step(
        df,
        size=F.length("data").cast("bigint"),
        ip_version=F.when(v4, "IPv4").otherwise("IPv6"),
        proto=F.when(v4, number(data, ip + 9, 1)).otherwise(number(data, ip + 6, 1)).cast("int"),
        _s=F.when(v4, ipv4_text(data, ip + 12)).otherwise(ipv6_groups(data, ip + 8)),
        _d=F.when(v4, ipv4_text(data, ip + 16)).otherwise(ipv6_groups(data, ip + 24)),
        fragment=F.when(v4, number(data, ip + 6, 2).bitwiseAND(0x1FFF)).otherwise(0),
        body=F.when(v4, body4).otherwise(body6),
    )
    df = step(df, _x=F.when(F.col("ip_version") == "IPv6", behind_extensions(F.col("proto"), F.col("body"))))
    late = F.col("_x.at") > 0
    df = df.withColumns({
        "body": F.when(late, rest(F.col("body"), F.col("_x.at"))).otherwise(F.col("body")),
        "proto": F.coalesce("_x.proto", "proto"), "fragment": F.coalesce("_x.fragment", "fragment"),
    })
    shown = {n: F.when(F.col("ip_version") == "IPv4", F.col(c)).otherwise(ipv6_text(F.col(c))) for n, c in (("src", "_s"), ("dst", "_d"))}
    return step(df, **shown).select("capture_id", "frame", "t_us", "size", "ip_version", "proto", "src", "dst", "fragment", "body")


def spi_and_seq(body: Column, proto: Column) -> tuple[Column, Column]:
    """SPI and sequence number; AH carries them four bytes in. A short body has no sequence."""
    at = F.when(proto == AH, 4).otherwise(0)
    return number(body, at, 4), F.when(F.length(body) >= at + 8, number(body, at + 4, 4))


def split_packets(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data packets, key-exchange datagrams with their bytes in ``ike``).

    On port 4500 four zero bytes mark a key-exchange message; anything else of eight bytes or more
    is an encapsulated data packet, and shorter payloads are keepalives.
    """
    is_udp = (F.col("proto") == UDP) & (F.col("fragment") == 0)
    sport, dport = number(F.col("body"), 0, 2), number(F.col("body"), 2, 2)
    length = number(F.col("body"), 4, 2)
    df = step(
        decoded,
        _4500=is_udp & ((sport == NAT_PORT) | (dport == NAT_PORT)),
        _500=is_udp & ((sport == IKE_PORT) | (dport == IKE_PORT)),
        _payload=F.when(is_udp, rest(F.col("body"), F.lit(8), F.when(length > 8, length - 8).otherwise(F.length("body")))),
    )
    marked = F.hex(F.substring("_payload", 1, 4)) == "00000000"
    df = step(
        df,
        _kind=F.when(F.col("proto").isin(ESP, AH), "esp")
        .when(F.col("_4500") & (F.length("_payload") > 0), F.when(marked, "ike").when(F.length("_payload") >= 8, "esp"))
        .when(F.col("_500") & (F.length("_payload") > 0), "ike"),
    )
    body = F.when(F.col("proto").isin(ESP, AH), F.col("body")).otherwise(F.col("_payload"))
    spi, seq = spi_and_seq(body, F.col("proto"))
    esp = df.filter("_kind = 'esp'").select("capture_id", "frame", "t_us", "size", "src", "dst", "proto", spi.alias("spi"), seq.alias("seq"))
    message = F.when(F.col("_4500"), rest(F.col("_payload"), F.lit(4))).otherwise(F.col("_payload"))
    ike = df.filter("_kind = 'ike'").select(
        "capture_id", "frame", "t_us", "ip_version", "src", "dst",
        F.when(F.col("_4500"), NAT_PORT).otherwise(IKE_PORT).alias("udp_port"), message.alias("ike"),
    )
    return esp, ike


def ike_header(datagrams: DataFrame) -> DataFrame:
    """Fixed header of each message; short messages and other versions drop out."""
    m = F.col("ike")
    version = number(m, 17, 1)
    long_enough = datagrams.filter(F.length("ike") >= IKE_HEADER)
    v1 = version == V1
    flags = number(m, 19, 1)
    out = step(
        long_enough,
        init_spi=F.lower(F.hex(F.substring("ike", 1, 8))),
        resp_spi=F.lower(F.hex(F.substring("ike", 9, 8))),
        next_payload=number(m, 16, 1).cast("int"),
        version_byte=version.cast("int"),
        exchange=number(m, 18, 1).cast("int"),
        flags=flags.cast("int"),
        is_response=flags.bitwiseAND(FLAG_RESPONSE) != 0,
        message_id=number(m, 20, 4),
        length=number(m, 24, 4),
        version=F.when(v1, "IKEv1").otherwise("IKEv2"),
    )
    return out.filter(F.col("version_byte").isin(V1, V2))


def ipsec_bytes_filter() -> Column:
    """Whether a decoded packet belongs to IPsec at all (for use right after the scan)."""
    ports = [number(F.col("body"), at, 2).isin(IKE_PORT, NAT_PORT) for at in (0, 2)]
    return F.col("proto").isin(ESP, AH) | ((F.col("proto") == UDP) & reduce(lambda a, b: a | b, ports))
