"""Rule, baseline and remediation tables. Ids, thresholds, patterns and citations are fixed values;
all wording is this library's own."""

from __future__ import annotations

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE")
PENALTY = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 10, "LOW": 5}
THREAT_GRADE = {"CRITICAL": ("High", "High"), "HIGH": ("Med", "High"), "MEDIUM": ("Med", "Med"), "LOW": ("Low", "Low")}


def _rule(id, severity, group, standard, when, text, cve=None, advisory=False):
    return {"id": id, "severity": severity, "group": group, "standard": standard, "when": when, "description": text,
            "cve": cve, "advisory": advisory}


RULES = [
    _rule("R01", "CRITICAL", "enc_weak", "NIST SP 800-77, RFC 8247", [("ike.encryption", "regex", r"^(des|null)\b")],
          "Cipher is single DES or no encryption at all"),
    _rule("R02", "HIGH", "enc_weak", "RFC 8247", [("ike.encryption", "regex", r"^3des")],
          "Triple DES cipher, open to birthday attacks on 64-bit blocks", cve="CVE-2016-2183"),
    _rule("R03", "CRITICAL", "dh_weak", "RFC 8247 s4, LOGJAM", [("ike.dh_group", "regex", r"modp768|\bgroup ?1\b")],
          "768-bit key exchange can be broken outright"),
    _rule("R04", "CRITICAL", "dh_weak", "RFC 8247 s4, LOGJAM", [("ike.dh_group", "regex", r"modp1024|\bgroup ?2\b")],
          "1024-bit key exchange falls to precomputation"),
    _rule("R05", "HIGH", "dh_weak", "RFC 8247 s4", [("ike.dh_group", "regex", r"modp1536|\bgroup ?5\b")],
          "1536-bit key exchange is under the recommended strength"),
    _rule("R06", "CRITICAL", "ikev1", "RFC 2409 s5.4",
          [("ike.version", "eq", "IKEv1"), ("ike.aggressive_mode", "eq", True), ("ike.auth_method", "eq", "PSK")],
          "Aggressive Mode with a shared key reveals a crackable hash"),
    _rule("R07", "HIGH", "ikev1", "RFC 9395", [("ike.version", "eq", "IKEv1")], "Retired protocol version 1 is in use"),
    _rule("R08", "CRITICAL", "integ_weak", "RFC 8247, SLOTH", [("ike.integrity", "regex", r"md5")],
          "MD5 protects message integrity"),
    _rule("R09", "HIGH", "integ_weak", "RFC 8247 s3", [("ike.integrity", "regex", r"sha-?1(\b|$)")],
          "SHA-1 protects message integrity"),
    _rule("R10", "MEDIUM", "pfs_off", "CNSSP-15", [("ike.pfs_status", "eq", "disabled")], "Child keys are derived without a fresh exchange"),
    _rule("R11", "MEDIUM", "lifetime", "NIST SP 800-77 s5", [("ike.sa_lifetime_sec", "gt", 86400)], "Keys live longer than one day"),
    _rule("R12", "LOW", "lifetime", "NIST SP 800-77r1 s4", [("ike.sa_lifetime_sec", "gt", 28800)], "Keys live longer than eight hours"),
    _rule("R13", "HIGH", "dh_weak", "RFC 7296 s2.15",
          [("ike.auth_method", "eq", "PSK"), ("ike.dh_group", "regex", r"modp(768|1024|1536)")],
          "Shared key combined with a weak key exchange"),
    _rule("R14", "HIGH", "frag", "CVE-2016-1287", [("ike.fragmented_ike", "eq", True), ("ike.vendor", "regex", r"cisco")],
          "Fragmented negotiation on a gateway family with a fragment-handling flaw", cve="CVE-2016-1287"),
    _rule("R15", "HIGH", "replay", "RFC 4303 s3.4.3", [("ike.anti_replay", "eq", False)], "Sequence numbers do not advance, replay is possible"),
    _rule("R16", "CRITICAL", "cert", "RFC 5280 s4.1.2.5", [("ike.cert.expired", "eq", True)], "Peer certificate is past its end date"),
    _rule("R17", "LOW", "dpd", "RFC 3706", [("ike.dpd_status", "eq", "disabled")], "No liveness check between the peers"),
    _rule("R18", "LOW", "ikev6", "RFC 8247 s1", [("ike.version", "eq", "IKEv1"), ("ike.ip_version", "eq", "IPv6")],
          "Version 1 negotiated over IPv6"),
    _rule("R19", "MEDIUM", "ikev1", "RFC 2409 s5.4, NIST SP 800-77r1 s4",
          [("ike.version", "eq", "IKEv1"), ("ike.aggressive_mode", "eq", True)], "Aggressive Mode sends identities in the clear"),
    _rule("R20", "LOW", "pqc", "RFC 9370, CNSA 2.0, NIST IR 8547", [("ike.pqc_status", "eq", "classical")],
          "Key exchange has no post-quantum part", advisory=True),
    _rule("R21", "MEDIUM", "drift", "NIST SP 800-77r1 s5 (configuration management)", [("ike.gateway_mismatches", "nonempty", True)],
          "Gateway configuration and negotiated values differ"),
]


# The rules that break each baseline, and what it requires besides.
BASELINES = [
    {"id": "NIST-800-77r1", "violated_by": "R01 R02 R03 R04 R05 R06 R07 R08 R09 R10 R11 R13 R15 R16 R19 R21".split(), "requires": []},
    {"id": "NIST-800-131A", "violated_by": "R01 R02 R03 R04 R05 R08 R16".split(), "requires": []},
    {"id": "BSI-TR-02102-3", "violated_by": "R01 R02 R03 R04 R05 R06 R07 R08 R09 R10 R11 R13 R15 R16 R19".split(), "requires": [
        ("ike.encryption", "regex", "^AES", "AES cipher"),
        ("ike.dh_group", "regex", "MODP(3072|4096|6144|8192)|ECP(256|384|521)|BRAINPOOL|ML-KEM", "strong key exchange group")]},
    {"id": "CNSA-2.0", "violated_by": "R01 R02 R03 R04 R05 R06 R07 R08 R09 R10 R11 R13 R15 R16 R19 R20".split(), "requires": [
        ("ike.encryption", "regex", "AES-256", "AES-256")]},
    {"id": "CERT-IN", "violated_by": "R01 R02 R03 R04 R06 R08 R14 R16".split(), "requires": []},
    {"id": "TEC-ITSAR", "violated_by": "R01 R02 R03 R04 R05 R06 R07 R08 R09 R15 R16".split(), "requires": []},
]

# Substrings of a lower-cased vendor name, first match wins, and the template key.
VENDOR_KEYS = (
    ("cisco", "cisco"), ("strongswan", "strongswan"), ("juniper", "juniper"), ("srx", "juniper"),
    ("fortinet", "fortinet"), ("fortigate", "fortinet"), ("palo", "paloalto"), ("pan-os", "paloalto"),
)
TEMPLATE_KEYS = ("cisco", "strongswan", "juniper", "fortinet", "paloalto", "generic")

FALLBACK = "No specific guidance; use AES-256-GCM, SHA-256 or better, ECP256 or better, fresh keys per child and lifetimes up to 8 hours."

# What to change, per group; and how a vendor's configuration names the thing to change.
_GOAL = {
    "dh_weak": "raise the key exchange group to 19 (ECP256) or 14 and above",
    "enc_weak": "switch the cipher to AES-256-GCM",
    "integ_weak": "switch integrity to SHA-256 or stronger",
    "ikev1": "move the tunnel to protocol version 2",
    "pfs_off": "turn on perfect forward secrecy with group 19",
    "lifetime": "cut key lifetimes to 8 hours or less",
    "frag": "install the release that fixes fragment handling",
    "replay": "turn the replay window on, 64 packets or more",
    "cert": "issue and install a new peer certificate",
    "dpd": "enable dead peer detection at 30 seconds",
    "ikev6": "move the IPv6 tunnel to protocol version 2",
    "pqc": "add an ML-KEM additional key exchange",
    "drift": "reconcile the running configuration with the intended one and renegotiate",
}
_WHERE = {
    "cisco": {"dh_weak": "crypto ikev2 policy / group", "enc_weak": "crypto ikev2 policy / encryption", "integ_weak": "crypto ikev2 policy / integrity",
              "ikev1": "crypto map / ikev2", "pfs_off": "crypto map / set pfs", "lifetime": "crypto ikev2 policy / lifetime",
              "frag": "show version, then upgrade", "replay": "crypto ipsec security-association replay", "dpd": "isakmp keepalive"},
    "strongswan": {"dh_weak": "proposals", "enc_weak": "proposals and esp_proposals", "integ_weak": "proposals", "ikev1": "version = 2",
                   "pfs_off": "esp_proposals", "lifetime": "rekey_time", "frag": "fragmentation", "replay": "replay_window", "dpd": "dpd_delay",
                   "pqc": "proposals with ke1_mlkem768", "drift": "swanctl --load-all"},
    "juniper": {"dh_weak": "security ike proposal dh-group", "enc_weak": "security ike proposal encryption-algorithm",
                "integ_weak": "security ike proposal authentication-algorithm", "ikev1": "security ike gateway version",
                "pfs_off": "security ipsec policy perfect-forward-secrecy", "lifetime": "security ike proposal lifetime-seconds",
                "frag": "software release", "replay": "security ipsec vpn anti-replay"},
    "fortinet": {"dh_weak": "phase1-interface dhgrp", "enc_weak": "phase1-interface proposal", "integ_weak": "phase1-interface proposal",
                 "ikev1": "phase1-interface ike-version", "pfs_off": "phase2-interface pfs", "lifetime": "phase1-interface keylife",
                 "frag": "firmware", "replay": "phase2-interface replay"},
    "paloalto": {"dh_weak": "IKE crypto profile, DH group", "enc_weak": "IKE crypto profile, encryption", "integ_weak": "IKE crypto profile, authentication",
                 "ikev1": "IKE gateway, version", "pfs_off": "IPsec crypto profile, DH group", "lifetime": "IKE crypto profile, lifetime",
                 "frag": "PAN-OS release", "replay": "tunnel, replay protection"},
}


def templates() -> dict[str, dict[str, str]]:
    """{group: {vendor key: text}}; a vendor without its own entry takes the generic one."""
    out = {}
    for group, goal in _GOAL.items():
        out[group] = {"generic": f"On the gateway, {goal}."}
        for vendor, places in _WHERE.items():
            if group in places:
                out[group][vendor] = f"{vendor}: under '{places[group]}', {goal}."
    return out


# Pages a citation links to, first contained key wins.
CVE_PAGE = "https://nvd.nist.gov/vuln/detail/"
STANDARD_PAGES = (
    ("RFC 8247", "https://www.rfc-editor.org/rfc/rfc8247"),
    ("RFC 9395", "https://www.rfc-editor.org/rfc/rfc9395"),
    ("RFC 4303", "https://www.rfc-editor.org/rfc/rfc4303"),
    ("NIST SP 800-77", "https://csrc.nist.gov/pubs/sp/800/77/r1/final"),
    ("CNSSP-15", "https://www.cnss.gov/CNSS/issuances/Policies.cfm"),
)

SEVERITY_GLOSS = {
    "CRITICAL": "Breaks confidentiality or authentication by itself, without another weakness.",
    "HIGH": "Breaks in combination with recorded traffic or with moderate computing power.",
    "MEDIUM": "Leaves the tunnel sound but widens what a later compromise reveals.",
    "LOW": "Costs availability or upkeep rather than secrecy.",
    "SAFE": "No rule fired.",
}
ANOMALY_GLOSS = {
    "AGGRESSIVE_MODE_PROBE": "Half-open version 1 negotiations in the three-message form, from which a shared key can be guessed offline.",
    "TRANSFORM_BRUTEFORCE": "Many different proposals from one address in a short span, most of them refused.",
    "SPI_COLLISION": "The same SPI in associations of more than one address pair.",
    "DOWNGRADE_SUSPECTED": "Two associations of a pair ended on different suites although both sides offered the stronger one.",
    "NAT_T_UNEXPECTED": "UDP encapsulation was negotiated although the initiator has a public address.",
    "REKEY_STORM": "More new associations of one pair per minute than any lifetime setting explains.",
}
