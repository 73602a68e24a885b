"""Bytes for test captures, written from the RFCs."""

import ipaddress
import struct


def payload(kind_next, body):
    return struct.pack(">BBH", kind_next, 0, len(body) + 4) + body


def chain(parts):
    """[(type, body)] -> (first type, bytes)."""
    out = b""
    for i, (_, body) in enumerate(parts):
        out += payload(parts[i + 1][0] if i + 1 < len(parts) else 0, body)
    return (parts[0][0] if parts else 0), out


def transform(kind, number, key_bits=None, last=False):
    attrs = struct.pack(">HH", 0x800E, key_bits) if key_bits else b""
    return struct.pack(">BBHBBH", 0 if last else 3, 0, 8 + len(attrs), kind, 0, number) + attrs


def sa(transforms, protocol=1):
    body = b"".join(transform(*t, last=i == len(transforms) - 1) for i, t in enumerate(transforms))
    return struct.pack(">BBHBBBB", 0, 0, 8 + len(body), 1, protocol, 0, len(transforms)) + body


def v1_sa(number, attrs):
    body = b"".join(struct.pack(">HH", 0x8000 | t, v) if v < 65536 else struct.pack(">HHI", t, 4, v) for t, v in attrs)
    tr = struct.pack(">BBHBBH", 0, 0, 8 + len(body), 1, number, 0) + body
    prop = struct.pack(">BBHBBBB", 0, 0, 8 + len(tr), 1, 1, 0, 1) + tr
    return struct.pack(">II", 1, 1) + prop


def ike(spi_i, spi_r, exchange, flags, msg_id, parts, version=0x20, raw=None, first=None):
    kind, body = chain(parts) if raw is None else (first, raw)
    return struct.pack(">QQBBBBII", spi_i, spi_r, kind, version, exchange, flags, msg_id, 28 + len(body)) + body


def ip(src, dst, proto, body):
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 4:
        return b"\x08\x00", struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + a.packed + b.packed + body
    return b"\x86\xdd", struct.pack(">IHBB", 0x60000000, len(body), proto, 64) + a.packed + b.packed + body


def udp(sport, dport, body):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def ether(typed, vlan=False):
    kind, body = typed
    tag = b"\x81\x00\x00\x05" if vlan else b""
    frame = b"\x02" * 12 + tag + kind + body
    return frame + b"\x00" * max(0, 60 - len(frame))


def pcap(frames, start=1_700_000_000.0, step=0.01, nano=False):
    out = struct.pack("<IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        us = round((start + i * step) * 1e6)
        out += struct.pack("<IIII", us // 10**6, us % 10**6 * (1000 if nano else 1), len(f), len(f)) + f
    return out


def pcapng(frames, start=1_700_000_000.0, step=0.01):
    def block(code, body):
        body += b"\x00" * (-len(body) % 4)
        return struct.pack("<II", code, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for i, f in enumerate(frames):
        us = round((start + i * step) * 1e6)
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    return out
