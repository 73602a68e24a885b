"""Parameter queries over the message stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.associations import IKE
from culvert.functions.codes import exchange_label
from culvert.operators import parameters as O
from culvert.plans import standins as S

KL = "CASE WHEN coalesce(key_length, 0) <> 0 THEN key_length ELSE 128 END"


def has(*types: int) -> str:
    return "(" + " OR ".join(f"list_contains(payload_types, {t})" for t in types) + ")"


def dh(col: str) -> str:
    names = {1: "MODP768", 2: "MODP1024", 5: "MODP1536", 14: "MODP2048", 15: "MODP3072", 16: "MODP4096", 17: "MODP6144", 18: "MODP8192",
             19: "ECP256", 20: "ECP384", 21: "ECP521", 31: "Curve25519", 32: "Curve448", 35: "ML-KEM-512", 36: "ML-KEM-768", 37: "ML-KEM-1024"}
    return f"(CASE {col} WHEN 0 THEN NULL " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE 'DH_GROUP_' || {col} END)"


ENC = f"""(CASE WHEN encr_id = 2 THEN 'DES-CBC' WHEN encr_id = 3 THEN '3DES-CBC' WHEN encr_id = 11 THEN 'NULL' WHEN encr_id = 28 THEN 'CHACHA20-POLY1305'
 WHEN encr_id = 12 THEN 'AES-' || {KL} || '-CBC' WHEN encr_id = 13 THEN 'AES-' || {KL} || '-CTR' WHEN encr_id IN (14, 15, 16) THEN 'AES-' || {KL} || '-CCM'
 WHEN encr_id IN (18, 19, 20) THEN 'AES-' || {KL} || '-GCM' WHEN encr_id = 23 THEN 'CAMELLIA-' || {KL} || '-CBC' ELSE 'ENCR_' || encr_id END)"""
AEAD = "coalesce(encr_id IN (14, 15, 16, 18, 19, 20, 28), FALSE)"
INT = f"""(CASE WHEN {AEAD} THEN 'implicit' WHEN integ_id = 0 THEN NULL WHEN integ_id = 1 THEN 'HMAC-MD5' WHEN integ_id = 2 THEN 'HMAC-SHA1' WHEN integ_id = 5 THEN 'AES-XCBC'
 WHEN integ_id = 12 THEN 'HMAC-SHA256' WHEN integ_id = 13 THEN 'HMAC-SHA384' WHEN integ_id = 14 THEN 'HMAC-SHA512' ELSE 'INTEG_' || integ_id END)"""
PRF = """(CASE prf_id WHEN 1 THEN 'PRF_HMAC_MD5' WHEN 2 THEN 'PRF_HMAC_SHA1' WHEN 4 THEN 'PRF_AES128_XCBC' WHEN 5 THEN 'PRF_HMAC_SHA2_256' WHEN 6 THEN 'PRF_HMAC_SHA2_384'
 WHEN 7 THEN 'PRF_HMAC_SHA2_512' ELSE 'PRF_' || prf_id END)"""
AUTH_NAME = "(CASE WHEN auth_id IN (1, 14) THEN 'RSA' WHEN auth_id = 2 THEN 'PSK' WHEN auth_id = 3 THEN 'DSS' WHEN auth_id IN (9, 10, 11) THEN 'ECDSA' ELSE 'AUTH_METHOD_' || auth_id END)"
V1ENC = f"""(CASE v1_encr WHEN 1 THEN 'DES-CBC' WHEN 2 THEN 'IDEA-CBC' WHEN 3 THEN 'BLOWFISH-CBC' WHEN 4 THEN 'RC5-CBC' WHEN 5 THEN '3DES-CBC' WHEN 6 THEN 'CAST-CBC'
 WHEN 7 THEN 'AES-' || {KL} || '-CBC' WHEN 8 THEN 'CAMELLIA-' || {KL} || '-CBC' ELSE 'ENCR_' || v1_encr END)"""
V1INT = "(CASE v1_hash WHEN 1 THEN 'HMAC-MD5' WHEN 2 THEN 'HMAC-SHA1' WHEN 4 THEN 'HMAC-SHA256' WHEN 5 THEN 'HMAC-SHA384' WHEN 6 THEN 'HMAC-SHA512' ELSE 'HASH_' || v1_hash END)"
V1PRF = "(CASE v1_hash WHEN 1 THEN 'PRF_HMAC_MD5' WHEN 2 THEN 'PRF_HMAC_SHA1' WHEN 4 THEN 'PRF_HMAC_SHA2_256' WHEN 5 THEN 'PRF_HMAC_SHA2_384' WHEN 6 THEN 'PRF_HMAC_SHA2_512' ELSE 'PRF_' || v1_hash END)"
V1AUTH = "(CASE WHEN v1_auth BETWEEN 65001 AND 65010 OR v1_auth IN (128, 129, 130, 131) THEN 'XAUTH' WHEN v1_auth = 1 THEN 'PSK' WHEN v1_auth = 2 THEN 'DSS' WHEN v1_auth IN (3, 4, 5) THEN 'RSA' ELSE 'AUTH_METHOD_' || v1_auth END)"
ESPENC = f"""(CASE WHEN esp_id = 2 THEN 'DES-CBC' WHEN esp_id = 3 THEN '3DES-CBC' WHEN esp_id = 4 THEN 'DES-IV32' WHEN esp_id = 5 THEN 'RC5-CBC' WHEN esp_id = 6 THEN 'IDEA-CBC' WHEN esp_id = 7 THEN 'CAST-CBC'
 WHEN esp_id = 8 THEN 'BLOWFISH-CBC' WHEN esp_id = 10 THEN 'DES-IV64' WHEN esp_id = 11 THEN 'NULL' WHEN esp_id = 12 THEN 'AES-' || {KL} || '-CBC' WHEN esp_id = 13 THEN 'AES-' || {KL} || '-CTR'
 WHEN esp_id IN (14, 15, 16) THEN 'AES-' || {KL} || '-CCM' WHEN esp_id IN (18, 19, 20) THEN 'AES-' || {KL} || '-GCM' ELSE 'ESP_' || esp_id END)"""
ESPINT = "(CASE esp_auth WHEN 1 THEN 'HMAC-MD5' WHEN 2 THEN 'HMAC-SHA1' WHEN 3 THEN 'DES-MAC' WHEN 5 THEN 'HMAC-SHA256' WHEN 6 THEN 'HMAC-SHA384' WHEN 7 THEN 'HMAC-SHA512' WHEN 8 THEN 'AES-XCBC' WHEN 9 THEN 'AES-CMAC' ELSE 'AUTH_' || esp_auth END)"
ADD = f"list_transform(list_filter(addke_ids, lambda i: i <> 0), lambda i: {dh('i')})"
VENDOR = """(CASE WHEN vid_hex LIKE '882fe56d6fd20dbc2251613b2ebe5beb%' THEN 'strongSwan' WHEN vid_hex LIKE '12f5f28c457168a9702d9fe274cc%' THEN 'Cisco'
 WHEN contains(vid_hex, lower(hex('FortiGate'))) THEN 'Fortinet' END)"""


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda v, ix: list_position({lst}, v) = ix)"


def pqc(group: str, extra: str) -> str:
    return f"(CASE WHEN {group} IS NULL OR {group} IN ('', 'unknown') THEN 'unknown' WHEN {extra} OR {group} LIKE 'ML-KEM%' THEN 'hybrid' ELSE 'classical' END)"


add(
    "canonical_names",
    lambda spark, d: O.canonical_names(S.ike_messages(spark, d)),
    f"""WITH {IKE} SELECT capture_id, init_spi, frame, {ENC} AS encryption, {INT} AS integrity, {PRF} AS prf, {dh('dh_id')} AS dh_group,
 CASE WHEN {has(48)} THEN 'EAP' ELSE {AUTH_NAME} END AS auth_method, {pqc(dh('dh_id'), f'len({ADD}) > 0')} AS pqc_status,
 {V1ENC} AS v1_encryption, {V1INT} AS v1_integrity, {V1PRF} AS v1_prf, {V1AUTH} AS v1_auth_method, {ESPENC} AS esp_encryption, {ESPINT} AS esp_integrity,
 {VENDOR} AS vendor FROM ike""",
)
add(
    "payload_flatten",
    lambda spark, d: O.flatten_payloads(S.ike_messages(spark, d)),
    f"WITH {IKE} SELECT capture_id, init_spi, frame, unnest(range(len(payload_types)))::INTEGER AS position, unnest(payload_types) AS payload_type FROM ike",
)

K = "capture_id, init_spi"
PROPOSAL_SQL = f"""
v2 AS (SELECT *, {ENC} AS enc, {INT} AS integ, {PRF} AS prf, {dh('dh_id')} AS dhg, {ordered_distinct(ADD)} AS extra, {has(33)} AS prop,
  CASE WHEN {has(34)} THEN {dh('ke_group')} END AS kedh FROM ike WHERE version = 'IKEv2'),
init AS (SELECT *, min(frame) FILTER (prop AND is_response) OVER (PARTITION BY {K}) AS reply_at FROM v2 WHERE exchange = 34),
eff AS (SELECT *, CASE WHEN is_response THEN 1 ELSE 0 END AS side FROM init WHERE prop AND (is_response OR reply_at IS NULL OR frame < reply_at)),
prop AS (SELECT {K}, arg_max(enc, (side, frame)) FILTER (enc IS NOT NULL) AS encryption, arg_max(integ, (side, frame)) FILTER (integ IS NOT NULL) AS integrity,
  arg_max(prf, (side, frame)) FILTER (prf IS NOT NULL) AS prf, arg_max(dhg, (side, frame)) FILTER (dhg IS NOT NULL) AS dh_proposed,
  arg_max(extra, (side, frame)) AS additional FROM eff GROUP BY {K}),
kes AS (SELECT {K}, arg_min(kedh, frame) FILTER (kedh IS NOT NULL) AS dh_from_ke, bool_or(prop AND is_response) AS saw_reply FROM init GROUP BY {K})"""


def _proposal(spark, d):
    p = O.accepted_proposal(S.ike_messages(spark, d))
    return p.withColumn("additional", F.array_join("additional", ","))


add(
    "accepted_proposal",
    _proposal,
    f"""WITH {IKE}, {PROPOSAL_SQL} SELECT {K}, encryption, integrity, prf, dh_proposed, array_to_string(additional, ',') AS additional, dh_from_ke, saw_reply
 FROM kes LEFT JOIN prop USING ({K})""",
)
CHILD_SQL = f"""
cn AS (SELECT {K}, arg_max(am, frame) FILTER (exchange = 35 AND am IS NOT NULL) AS auth_method,
  bool_or(exchange = 35 AND tr) AS saw_transport, bool_or(exchange = 35 AND (au OR ea OR ch)) AS saw_readable_auth, bool_or(ch AND ky) AS child_keyed,
  bool_or(exchange = 36 AND ch) AS saw_rekey, bool_or(exchange = 35 AND ch) AS saw_auth_child FROM (
  SELECT *, {has(39)} AS au, {has(48)} AS ea, {has(33)} AND proposal_protocol IN (2, 3) AS ch, {has(34)} OR coalesce(dh_id, 0) <> 0 AS ky,
   {has(41)} AND list_contains(notify_types, 16391) AS tr, CASE WHEN {has(48)} THEN 'EAP' WHEN {has(39)} THEN {AUTH_NAME} END AS am
  FROM ike WHERE version = 'IKEv2' AND exchange IN (35, 36)) GROUP BY {K})"""
add(
    "child_negotiations",
    lambda spark, d: O.child_negotiations(S.ike_messages(spark, d)),
    f"WITH {IKE}, {CHILD_SQL} SELECT * FROM cn",
)
SIGNAL_SQL = f"""
sig AS (SELECT {K}, any_value(version) AS version, coalesce(arg_min(vn, frame) FILTER (vn IS NOT NULL), 'unknown') AS vendor, bool_or({has(53, 132)}) AS fragmented_ike,
  bool_or(udp_port = 4500 OR (version = 'IKEv1' AND {has(20, 130)})) AS nat_traversal,
  bool_or(coalesce(vidp LIKE 'afcad71368a1f1c96b8696fc7757%', FALSE) OR (version = 'IKEv2' AND exchange = 37 AND len(payload_types) = 0)) AS dpd_seen
  FROM (SELECT *, CASE WHEN {has(43, 13)} THEN {VENDOR} END AS vn, CASE WHEN {has(43, 13)} THEN vid_hex END AS vidp FROM ike) GROUP BY {K})"""
add("session_signals", lambda spark, d: O.signals(S.ike_messages(spark, d)), f"WITH {IKE}, {SIGNAL_SQL} SELECT * FROM sig")

V2_SQL = f"""{PROPOSAL_SQL}, {CHILD_SQL}, {SIGNAL_SQL},
v2sa AS (SELECT {K}, bool_or(exchange = 34) AS saw_init FROM ike WHERE version = 'IKEv2' GROUP BY {K}),
v2p AS (SELECT s.capture_id, s.init_spi, 'IKEv2' AS version, FALSE AS aggressive_mode, coalesce(encryption, 'unknown') AS encryption, coalesce(integrity, 'unknown') AS integrity,
  coalesce(prf, 'unknown') AS prf, coalesce(dh_proposed, dh_from_ke, 'unknown') AS dh_group, coalesce(array_to_string(additional, ','), '') AS additional_key_exchanges, auth_method,
  CASE WHEN saw_transport THEN 'transport' WHEN saw_readable_auth THEN 'tunnel' ELSE 'unknown' END AS mode,
  CASE WHEN child_keyed THEN 'enabled' WHEN saw_rekey THEN 'disabled' WHEN (coalesce(saw_reply, FALSE) OR (saw_init AND encryption IS NOT NULL)) AND saw_auth_child THEN 'disabled' ELSE 'unknown' END AS pfs_status,
  NULL::BIGINT AS sa_lifetime_sec, coalesce(saw_reply, FALSE) OR (saw_init AND encryption IS NOT NULL) AS capture_complete, vendor, fragmented_ike, nat_traversal,
  CASE WHEN dpd_seen THEN 'enabled' ELSE 'unknown' END AS dpd_status, {pqc('coalesce(dh_proposed, dh_from_ke)', 'coalesce(len(additional), 0) > 0')} AS pqc_status
  FROM v2sa s LEFT JOIN kes USING ({K}) LEFT JOIN prop USING ({K}) LEFT JOIN cn USING ({K}) LEFT JOIN sig USING ({K}))"""
V1_SQL = f"""
v1 AS (SELECT *, {has(1)} AS hsa, {has(5)} AS hid, {has(4)} AS hke, {V1ENC} AS e1, {V1INT} AS i1, {V1PRF} AS p1, {V1AUTH} AS a1, {dh('v1_group')} AS g1,
  {ESPENC} AS e2, {ESPINT} AS i2, {dh('p2_group')} AS g2, CASE WHEN life_type IS NULL OR life_type = 1 THEN life_value END AS life FROM ike WHERE version = 'IKEv1'),
op AS (SELECT * FROM v1 WHERE hsa AND message_id = 0 QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY frame) = 1),
ot AS (SELECT * FROM v1 WHERE hsa AND exchange <> 32 QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY frame) = 1),
qm AS (SELECT * FROM v1 WHERE hsa AND exchange = 32 QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY frame) = 1),
ph1 AS (SELECT * FROM op UNION ALL SELECT * FROM ot WHERE ({K}) NOT IN (SELECT ({K}) FROM op)),
v1sa AS (SELECT {K}, bool_or(exchange = 4) AS anyag FROM v1 GROUP BY {K}),
v1p AS (SELECT s.capture_id, s.init_spi, 'IKEv1' AS version, CASE WHEN op.frame IS NOT NULL THEN op.hid OR op.exchange = 4 ELSE anyag END AS aggressive_mode,
  coalesce(qm.e2, ph1.e1, 'unknown') AS encryption, coalesce(qm.i2, ph1.i1, 'unknown') AS integrity, coalesce(ph1.p1, 'unknown') AS prf, coalesce(qm.g2, ph1.g1, 'unknown') AS dh_group,
  '' AS additional_key_exchanges, ph1.a1 AS auth_method, CASE WHEN qm.encap IN (2, 4) THEN 'transport' WHEN qm.encap IN (1, 3) THEN 'tunnel' ELSE 'unknown' END AS mode,
  CASE WHEN qm.frame IS NULL THEN 'unknown' WHEN qm.hke OR coalesce(qm.p2_group, 0) <> 0 THEN 'enabled' ELSE 'disabled' END AS pfs_status, coalesce(qm.life, ph1.life) AS sa_lifetime_sec,
  op.frame IS NOT NULL AS capture_complete, vendor, fragmented_ike, nat_traversal,
  CASE WHEN dpd_seen THEN 'enabled' WHEN op.frame IS NOT NULL THEN 'disabled' ELSE 'unknown' END AS dpd_status, {pqc('coalesce(qm.g2, ph1.g1)', 'FALSE')} AS pqc_status
  FROM v1sa s LEFT JOIN op USING ({K}) LEFT JOIN ph1 USING ({K}) LEFT JOIN qm USING ({K}) LEFT JOIN sig USING ({K}))"""
add("v2_parameters", lambda spark, d: O.v2_parameters(S.ike_messages(spark, d)), f"WITH {IKE}, {V2_SQL} SELECT * FROM v2p")
add("v1_parameters", lambda spark, d: O.v1_parameters(S.ike_messages(spark, d)), f"WITH {IKE}, {SIGNAL_SQL}, {V1_SQL} SELECT * FROM v1p")
add(
    "session_parameters",
    lambda spark, d: O.parameters(S.ike_messages(spark, d)),
    f"WITH {IKE}, {V2_SQL}, {V1_SQL} SELECT * FROM v2p UNION ALL SELECT * FROM v1p",
)
add(
    "exchange_labels",
    lambda spark, d: O.v1_parameters(S.ike_messages(spark, d)).select(*O.SA, exchange_label(F.col("aggressive_mode")).alias("exchange_mode")),
    f"WITH {IKE}, {SIGNAL_SQL}, {V1_SQL} SELECT {K}, CASE WHEN aggressive_mode THEN 'Aggressive Mode' ELSE 'Main Mode' END AS exchange_mode FROM v1p",
)


def _retransmit_sql(side: str) -> str:
    return f"""WITH {IKE}, g AS (SELECT {K}, t_us - lag(t_us) OVER (PARTITION BY {K}, exchange, message_id, is_response, {side} ORDER BY t_us, frame) AS gap FROM ike),
 m AS (SELECT {K}, quantile_cont(gap, 0.5) FILTER (gap > 0) AS med, count(*) FILTER (gap > 0) AS n FROM g GROUP BY {K})
 SELECT {K}, CASE WHEN n >= 2 THEN round_even(med / 1000.0::DOUBLE, 0)::BIGINT END AS retransmit_interval_ms FROM m"""


add("retransmit_interval", lambda spark, d: O.retransmit_interval(S.ike_messages(spark, d)), _retransmit_sql("1"))
add(
    "retransmit_by_direction",
    lambda spark, d: O.retransmit_interval(S.ike_messages(spark, d), v1_by_direction=True),
    _retransmit_sql("CASE WHEN version = 'IKEv1' THEN src END"),
)
AS_OF_US = 946684800000000  # fixed instant the certificate check is made for
add(
    "certificate_facts",
    lambda spark, d: O.certificate_facts(S.ike_messages(spark, d), AS_OF_US),
    f"""WITH {IKE} SELECT {K}, arg_min(cert_subject, frame) AS subject, arg_min(cert_issuer, frame) AS issuer, arg_min(cert_not_after_us, frame) AS not_after_us,
 arg_min(cert_not_after_us, frame) < {AS_OF_US} AS expired, arg_min(cert_subject, frame) = arg_min(cert_issuer, frame) AS self_signed
 FROM ike WHERE cert_subject IS NOT NULL GROUP BY {K}""",
)
add(
    "structural_features",
    lambda spark, d: O.structural_features(S.ike_messages(spark, d)),
    f"""WITH {IKE}, f AS (SELECT * FROM ike QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY exchange <> 34, frame) = 1), t AS (SELECT *, CASE WHEN {has(33)} THEN n_transforms ELSE 0 END AS nt FROM f)
 SELECT {K}, exchange = 34 AS has_sa_init, length::DOUBLE AS sa_init_bytes, (CASE WHEN {has(34)} THEN ke_len ELSE 0 END)::DOUBLE AS ke_data_len, len(payload_types)::DOUBLE AS n_payloads, nt::DOUBLE AS n_transforms,
 {has(34)}::INT::DOUBLE AS has_ke, {has(40)}::INT::DOUBLE AS has_nonce, {has(41)}::INT::DOUBLE AS has_natd, (nt > 0 AND integ_id IS NULL)::INT::DOUBLE AS aead_hint,
 (CASE WHEN nt > 0 THEN coalesce(key_length, 0) ELSE 0 END)::DOUBLE AS keylen_attr FROM t""",
)
