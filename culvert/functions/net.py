"""Addresses as Column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address ranges treated as not public, as (first, last) of IPv4 integers.
PRIVATE_V4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
# Addresses inside those ranges that are public.
PUBLIC_V4 = ("192.0.0.9", "192.0.0.10")
# IPv6 networks treated as not public, and those inside them that are public.
PRIVATE_V6 = ("::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
V6_PATTERN = r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$"


def v4_number(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad as BIGINT, NULL for anything else."""

    def number(part: Column) -> Column:
        def octet(i: int) -> Column:
            return F.try_element_at(part, F.lit(i)).cast("bigint")

        return ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)

    return F.when(ip.rlike(V4_PATTERN), bound(F.split(ip, r"\."), number))


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text (one optional ``::``, dotted last 32 bits allowed) as 32 hex digits, NULL when it is not that."""

    def undotted(dotted: Column) -> Column:
        digits = F.lpad(F.hex(dotted), 8, "0")
        groups = F.concat(F.regexp_extract(ip, r"^(.*:)[0-9.]+$", 1), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
        return F.when(dotted.isNotNull(), groups).otherwise(ip)

    def parts(ip: Column) -> Column:
        halves = F.split(F.lower(ip), "::")
        head = F.filter(F.split(F.try_element_at(halves, F.lit(1)), ":"), lambda g: g != "")
        tail = F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), ":"), lambda g: g != "")
        return F.struct(ip.alias("ip"), F.size(halves).alias("halves"), head.alias("head"), tail.alias("tail"))

    def pad(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def whole(p: Column) -> Column:
        given = F.size(p["head"]) + F.size(p["tail"])
        zeros = F.repeat(F.lit("0000"), (F.lit(8) - given).cast("int"))
        gap = p["ip"].contains("::")
        well_formed = (
            p["ip"].rlike(V6_PATTERN)
            & (p["halves"] <= 2)
            & F.when(gap, given <= 7).otherwise(given == 8)
            & F.forall(F.concat(p["head"], p["tail"]), lambda g: F.length(g) <= 4)
        )
        return F.when(well_formed, F.concat(pad(p["head"]), zeros, pad(p["tail"])))

    plain = bound(ipv4_to_long(F.regexp_extract(ip, r":([0-9.]+)$", 1)), undotted)
    return F.when(ip.contains(":"), bound(plain, lambda ip: bound(parts(ip), whole)))


def _inside_v4(number: Column) -> Column:
    inside = reduce(lambda a, b: a | b, [number.between(v4_number(lo), v4_number(hi)) for lo, hi in PRIVATE_V4])
    return inside & ~number.isin(*[v4_number(a) for a in PUBLIC_V4])


def _inside_v6(digits: Column, networks: tuple[str, ...]) -> Column:
    """Equal length hex compares like the number."""
    nets = [ipaddress.ip_network(n) for n in networks]
    return reduce(lambda a, b: a | b, [digits.between(*(f"{int(x):032x}" for x in (n[0], n[-1]))) for n in nets])


def is_public(ip: Column) -> Column:
    """True for a parsable address outside the fixed ranges; unparsable is not public.

    An IPv6 address that maps an IPv4 one is judged by the latter.
    """

    def judged(digits: Column) -> Column:
        mapped = F.when(digits.startswith("0" * 20 + "ffff"), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))
        private6 = _inside_v6(digits, PRIVATE_V6) & ~_inside_v6(digits, PUBLIC_V6)
        return F.when(digits.isNull(), False).otherwise(F.coalesce(bound(mapped, lambda n: ~_inside_v4(n)), ~private6))

    def by_number(number: Column) -> Column:
        return F.when(number.isNotNull(), ~_inside_v4(number)).otherwise(bound(ipv6_hex(ip), judged))

    return bound(ipv4_to_long(ip), by_number)


def peer_pair(a: Column, b: Column) -> Column:
    """Unordered pair as one text key, the smaller address first."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))
