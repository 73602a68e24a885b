"""Registry numbers of the key-exchange protocols as canonical names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol registry numbers and the names used for them everywhere else.
AEAD_ENCR = (14, 15, 16, 18, 19, 20, 28)
V2_PLAIN_ENCR = {2: "DES-CBC", 3: "3DES-CBC", 11: "NULL", 28: "CHACHA20-POLY1305"}
V2_SIZED_ENCR = {12: ("AES", "CBC"), 13: ("AES", "CTR"), 14: ("AES", "CCM"), 15: ("AES", "CCM"), 16: ("AES", "CCM"),
                 18: ("AES", "GCM"), 19: ("AES", "GCM"), 20: ("AES", "GCM"), 23: ("CAMELLIA", "CBC")}
V2_INTEG = {1: "HMAC-MD5", 2: "HMAC-SHA1", 5: "AES-XCBC", 12: "HMAC-SHA256", 13: "HMAC-SHA384", 14: "HMAC-SHA512"}
V2_PRF = {1: "PRF_HMAC_MD5", 2: "PRF_HMAC_SHA1", 4: "PRF_AES128_XCBC", 5: "PRF_HMAC_SHA2_256",
          6: "PRF_HMAC_SHA2_384", 7: "PRF_HMAC_SHA2_512"}
DH = {1: "MODP768", 2: "MODP1024", 5: "MODP1536", 14: "MODP2048", 15: "MODP3072", 16: "MODP4096", 17: "MODP6144",
      18: "MODP8192", 19: "ECP256", 20: "ECP384", 21: "ECP521", 31: "Curve25519", 32: "Curve448",
      35: "ML-KEM-512", 36: "ML-KEM-768", 37: "ML-KEM-1024"}
V2_AUTH = {1: "RSA", 2: "PSK", 3: "DSS", 9: "ECDSA", 10: "ECDSA", 11: "ECDSA", 14: "RSA"}
V1_PLAIN_ENCR = {1: "DES-CBC", 2: "IDEA-CBC", 3: "BLOWFISH-CBC", 4: "RC5-CBC", 5: "3DES-CBC", 6: "CAST-CBC"}
V1_SIZED_ENCR = {7: ("AES", "CBC"), 8: ("CAMELLIA", "CBC")}
V1_HASH_INTEG = {1: "HMAC-MD5", 2: "HMAC-SHA1", 4: "HMAC-SHA256", 5: "HMAC-SHA384", 6: "HMAC-SHA512"}
V1_HASH_PRF = {1: "PRF_HMAC_MD5", 2: "PRF_HMAC_SHA1", 4: "PRF_HMAC_SHA2_256", 5: "PRF_HMAC_SHA2_384", 6: "PRF_HMAC_SHA2_512"}
V1_AUTH = {1: "PSK", 2: "DSS", 3: "RSA", 4: "RSA", 5: "RSA", 128: "XAUTH", 129: "XAUTH", 130: "XAUTH", 131: "XAUTH"}
V1_XAUTH_RANGE = (65001, 65010)
ESP_PLAIN = {2: "DES-CBC", 3: "3DES-CBC", 4: "DES-IV32", 5: "RC5-CBC", 6: "IDEA-CBC", 7: "CAST-CBC", 8: "BLOWFISH-CBC",
             10: "DES-IV64", 11: "NULL"}
ESP_SIZED = {12: ("AES", "CBC"), 13: ("AES", "CTR"), 14: ("AES", "CCM"), 15: ("AES", "CCM"), 16: ("AES", "CCM"),
             18: ("AES", "GCM"), 19: ("AES", "GCM"), 20: ("AES", "GCM")}
ESP_AUTH = {1: "HMAC-MD5", 2: "HMAC-SHA1", 3: "DES-MAC", 5: "HMAC-SHA256", 6: "HMAC-SHA384", 7: "HMAC-SHA512",
            8: "AES-XCBC", 9: "AES-CMAC"}
VENDOR_PREFIXES = (
    ("882fe56d6fd20dbc2251613b2ebe5beb", "strongSwan"),
    ("4f45", "OpenSwan"),
    ("12f5f28c457168a9702d9fe274cc", "Cisco"),
    ("1f07f70eaa6514d3b0fa96542a50", "Cisco"),
    ("3e984048101927ba7b1c17d9c4b6", "Cisco"),
    ("409b8a300d0d2c479a0e30a2f24a", "Cisco"),
    ("cd60464335df21f87cfdb2fc68b6", "Cisco"),
    ("6d761ddc26aceca1b0ed11fabbb8", "Cisco"),
    ("699369228741c6d4ca094c93e242c9de", "Juniper"),
    ("4865617274426561742d4e6f74696679", "Juniper"),
    ("2a2bcac19b8e91b426107807e02e7249", "Juniper"),
    ("8299031757a36082c6a621de000500", "Fortinet"),
    ("1d6e178f6c2c0be284985465450fe9d4", "Fortinet"),
    ("da8e937880010000", "Palo Alto"),
    ("581cf88b0324eb1e5f95a9e2c39d", "Palo Alto"),
    ("1e2b516905991c7d7c96fcbfb587e461", "Microsoft"),
    ("8f8d83826d246b6fc7a8a6a428c11de8", "Microsoft"),
    ("4a131c81070358455c5728f20e95452f", "Microsoft"),
    ("90cb80913ebb696e086381b5ec427b1f", "Microsoft"),
)
VENDOR_MARKERS = (
    ("strongSwan", "strongSwan"), ("Openswan", "OpenSwan"), ("Libreswan", "Libreswan"), ("CISCO", "Cisco"),
    ("Cisco Systems", "Cisco"), ("FRADE", "Cisco"), ("Netscreen", "Juniper"), ("NetScreen", "Juniper"),
    ("SRX", "Juniper"), ("FortiGate", "Fortinet"), ("Fortinet", "Fortinet"), ("Palo Alto", "Palo Alto"),
    ("GlobalProtect", "Palo Alto"), ("Microsoft", "Microsoft"), ("MS NT5", "Microsoft"),
)
DPD_VENDOR_PREFIX = "afcad71368a1f1c96b8696fc7757"


def lookup(code: Column, table: dict, default: Column | None = None) -> Column:
    """A small code table as one CASE expression; stays inside code generation."""
    items = list(table.items())
    out = F.when(code == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(code == key, F.lit(value))
    return out.otherwise(default) if default is not None else out


def _named(code: Column, plain: dict, sized: dict, key_length: Column | None, prefix: str) -> Column:
    """Plain names, then names that carry a key length (128 when none was sent), then a fallback."""
    bits = F.coalesce(F.when(key_length != 0, key_length), F.lit(128)).cast("string") if key_length is not None else None
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for number, name in plain.items():
        out = out.when(code == number, F.lit(name))
    for number, (family, block) in sized.items():
        out = out.when(code == number, F.concat(F.lit(f"{family}-"), bits, F.lit(f"-{block}")))
    return out.otherwise(F.concat(F.lit(prefix), code.cast("string")))


def v2_encryption(code: Column, key_length: Column) -> Column:
    return _named(code, V2_PLAIN_ENCR, V2_SIZED_ENCR, key_length, "ENCR_")


def is_aead(code: Column) -> Column:
    return F.coalesce(code.isin(*AEAD_ENCR), F.lit(False))


def v2_integrity(code: Column, aead: Column) -> Column:
    """``implicit`` under an AEAD cipher; NULL when absent or NONE."""
    return F.when(aead, F.lit("implicit")).when(code != 0, _named(code, V2_INTEG, {}, None, "INTEG_"))


def v2_prf(code: Column) -> Column:
    return _named(code, V2_PRF, {}, None, "PRF_")


def dh_group(code: Column) -> Column:
    return F.when(code != 0, _named(code, DH, {}, None, "DH_GROUP_"))


def v2_auth(code: Column, eap: Column) -> Column:
    return F.when(eap, F.lit("EAP")).otherwise(_named(code, V2_AUTH, {}, None, "AUTH_METHOD_"))


def v1_encryption(code: Column, key_length: Column) -> Column:
    return _named(code, V1_PLAIN_ENCR, V1_SIZED_ENCR, key_length, "ENCR_")


def v1_integrity(code: Column) -> Column:
    return _named(code, V1_HASH_INTEG, {}, None, "HASH_")


def v1_prf(code: Column) -> Column:
    return _named(code, V1_HASH_PRF, {}, None, "PRF_")


def v1_auth(code: Column) -> Column:
    return F.when(code.between(*V1_XAUTH_RANGE), F.lit("XAUTH")).otherwise(
        _named(code, V1_AUTH, {}, None, "AUTH_METHOD_")
    )


def esp_encryption(code: Column, key_length: Column) -> Column:
    return _named(code, ESP_PLAIN, ESP_SIZED, key_length, "ESP_")


def esp_integrity(code: Column) -> Column:
    return _named(code, ESP_AUTH, {}, None, "AUTH_")


def pqc_status(group: Column, additional: Column) -> Column:
    known = group.isNotNull() & ~group.isin("", "unknown")
    hybrid = (F.coalesce(F.size(additional), F.lit(0)) > 0) | group.startswith("ML-KEM")
    return F.when(~known, F.lit("unknown")).when(hybrid, F.lit("hybrid")).otherwise(F.lit("classical"))


def vendor_of(vid_hex: Column) -> Column:
    """Vendor announced by one Vendor ID payload (hex text), NULL when it is not a known one."""
    digits = F.lower(vid_hex)
    out = None
    for prefix, vendor in VENDOR_PREFIXES:
        hit = digits.startswith(prefix)
        out = F.when(hit, F.lit(vendor)) if out is None else out.when(hit, F.lit(vendor))
    whole_bytes = digits.rlike("^([0-9a-f]{2})*$")
    raw = F.when(whole_bytes, F.decode(F.unhex(digits), "ISO-8859-1"))
    for marker, vendor in VENDOR_MARKERS:
        out = out.when(raw.contains(marker), F.lit(vendor))
    return out


def exchange_label(aggressive: Column) -> Column:
    return F.when(aggressive, F.lit("Aggressive Mode")).otherwise(F.lit("Main Mode"))
