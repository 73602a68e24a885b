"""Association queries over the message and packet stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.flows import BASE, ESP, flow_cte
from culvert.functions.net import peer_pair
from culvert.operators import associations as O
from culvert.operators import flows as FL
from culvert.plans import standins as S
from culvert.plans.skew import attach

IKE = S.duck_cte("ike")
SA_SQL = """
sa AS (SELECT capture_id, init_spi,
  init_spi || '-' || coalesce(arg_min(resp_spi, frame) FILTER (resp_spi <> '0000000000000000'), '0000000000000000') AS session_id,
  arg_min(version, frame) AS version,
  CASE WHEN arg_min(src, frame) LIKE '%:%' THEN 'IPv6' ELSE 'IPv4' END AS ip_version,
  coalesce(arg_min(src, frame) FILTER (NOT is_response AND message_id = 0), arg_min(src, frame)) AS initiator_ip,
  coalesce(arg_min(dst, frame) FILTER (NOT is_response AND message_id = 0), arg_min(dst, frame)) AS responder_ip,
  bool_or(udp_port = 4500) AS nat_traversal,
  bool_or(list_contains(payload_types, 53) OR list_contains(payload_types, 132)) AS fragmented,
  bool_or(message_id = 0 AND exchange IN (34, 2, 4)) AS complete,
  count(*) AS ike_packets, min(t_us) FILTER (t_us <> 0) AS first_t_us
  FROM ike GROUP BY capture_id, init_spi)"""
OWNER_SQL = """
sa_pairs AS (SELECT DISTINCT capture_id, least(initiator_ip, responder_ip) || '|' || greatest(initiator_ip, responder_ip) AS owner,
  initiator_ip AS ia, responder_ip AS ra FROM sa),
sp AS (SELECT DISTINCT capture_id, owner, least(ia, ra) AS low, greatest(ia, ra) AS high FROM sa_pairs),
pp AS (SELECT capture_id, peers, min(least(src, dst)) AS low, min(greatest(src, dst)) AS high, count(*) AS pair_packets FROM base GROUP BY 1, 2),
cand AS (SELECT p.capture_id, p.peers, count(DISTINCT s.owner) AS nc, min(s.owner) AS one, bool_or(s.owner = p.peers) AS exact
  FROM pp p JOIN sp s ON p.capture_id = s.capture_id AND (s.low IN (p.low, p.high) OR s.high IN (p.low, p.high)) GROUP BY 1, 2),
owners AS (SELECT p.*, CASE WHEN exact THEN p.peers WHEN nc = 1 THEN one END AS owner,
  CASE WHEN exact THEN 'exact' WHEN nc = 1 THEN 'nat' WHEN nc > 1 THEN 'ambiguous' ELSE 'none' END AS ownership
  FROM pp p LEFT JOIN cand c ON p.capture_id = c.capture_id AND p.peers = c.peers),
owned AS (SELECT b.*, o.owner, o.ownership FROM base b JOIN owners o USING (capture_id, peers))"""
REPLAY = """CASE WHEN bool_or(n >= 4 AND d = 1) THEN FALSE WHEN bool_or(n >= 4) THEN TRUE END"""


def _sa(spark, d):
    return O.group_messages(S.ike_messages(spark, d))


add("sa_groups", _sa, f"WITH {IKE}, {SA_SQL} SELECT * FROM sa")


def _sa_by_pair(spark, d):
    m = S.ike_messages(spark, d).withColumn("peers", peer_pair(F.col("src"), F.col("dst")))
    return O.group_messages(m, [*O.SA, "peers"]).groupBy("capture_id", "init_spi").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("ike_packets").alias("messages")
    )


add(
    "sa_groups_per_pair",
    _sa_by_pair,
    f"WITH {IKE} SELECT capture_id, init_spi, count(DISTINCT least(src, dst) || '|' || greatest(src, dst)) AS pairs, "
    "count(*) AS messages FROM ike GROUP BY ALL",
)
add(
    "ipsec_filter",
    lambda spark, d: O.ipsec_only(S.esp_packets(spark, d)).select("capture_id", "frame", "proto", "src", "dst", "size"),
    f"WITH {ESP} SELECT capture_id, frame, proto, src, dst, size FROM esp WHERE proto IN (50, 51)",
)
add(
    "pair_owners",
    lambda spark, d: O.pair_owners(O.packet_pairs(S.esp_packets(spark, d)), O.sa_pairs(_sa(spark, d))),
    f"WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL} SELECT capture_id, peers, low, high, pair_packets, owner, ownership FROM owners",
)
add(
    "packet_owners",
    lambda spark, d: O.own_packets(S.esp_packets(spark, d), _sa(spark, d)).select("capture_id", "frame", "owner", "ownership"),
    f"WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL} SELECT capture_id, frame, owner, ownership FROM owned",
)
add(
    "orphan_packets",
    lambda spark, d: O.orphan_packets(S.esp_packets(spark, d), _sa(spark, d)).select("capture_id", "frame", "peers", "ownership"),
    f"WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL} SELECT capture_id, frame, peers, ownership FROM owned WHERE owner IS NULL",
)
add(
    "orphan_evidence",
    lambda spark, d: O.orphan_evidence(O.orphan_packets(S.esp_packets(spark, d), _sa(spark, d))),
    f"""WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL}, orph AS (SELECT * FROM owned WHERE owner IS NULL),
ids AS (SELECT capture_id, peers, 'esp-' || lpad(lower(to_hex(arg_min(coalesce(spi, 0), frame))), 8, '0') AS session_id FROM orph GROUP BY ALL)
SELECT capture_id, peers, session_id, frame, size FROM orph JOIN ids USING (capture_id, peers)""",
)
PER_OWNER = f"""
spis AS (SELECT capture_id, owner, coalesce(spi, 0) AS spi, count(*) AS n, count(DISTINCT coalesce(seq, 0)) AS d FROM owned WHERE owner IS NOT NULL GROUP BY ALL),
per_owner AS (SELECT capture_id, owner, sum(n)::BIGINT AS esp_packets, {REPLAY} AS anti_replay FROM spis GROUP BY ALL)"""
add(
    "sa_esp_anti_replay",
    lambda spark, d: O.esp_per_association(_sa(spark, d), S.esp_packets(spark, d)).select(
        "capture_id", "init_spi", "session_id", "owner", "esp_packets", "anti_replay"
    ),
    f"""WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL}, {PER_OWNER}
SELECT s.capture_id, init_spi, session_id, least(initiator_ip, responder_ip) || '|' || greatest(initiator_ip, responder_ip) AS owner,
 coalesce(esp_packets, 0) AS esp_packets, anti_replay FROM sa s LEFT JOIN per_owner p
 ON s.capture_id = p.capture_id AND p.owner = least(initiator_ip, responder_ip) || '|' || greatest(initiator_ip, responder_ip)""",
)


def _mid(spark, d):
    rec = O.mid_session_records(O.orphan_packets(S.esp_packets(spark, d), _sa(spark, d)))
    return rec.withColumn("packet_refs", F.array_join(F.col("packet_refs").cast("array<string>"), ","))


add(
    "mid_session_records",
    _mid,
    f"""WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL},
orph AS (SELECT *, row_number() OVER (PARTITION BY capture_id, peers ORDER BY frame) AS rn FROM owned WHERE owner IS NULL),
spis AS (SELECT capture_id, peers, coalesce(spi, 0) AS spi, count(*) AS n, count(DISTINCT coalesce(seq, 0)) AS d FROM orph GROUP BY ALL),
rep AS (SELECT capture_id, peers, sum(n)::BIGINT AS esp_packets, {REPLAY} AS anti_replay FROM spis GROUP BY ALL)
SELECT capture_id, peers, 'esp-' || lpad(lower(to_hex(coalesce(arg_min(coalesce(spi, 0), frame), 0))), 8, '0') AS session_id,
 arg_min(src, frame) AS initiator_ip, arg_min(dst, frame) AS responder_ip, 'IPv4' AS ip_version, 'IKEv2' AS version,
 'unknown' AS encryption, 'unknown' AS integrity, 'unknown' AS prf, 'unknown' AS dh_group, 'unknown' AS pfs_status, FALSE AS complete,
 string_agg(frame::VARCHAR, ',' ORDER BY frame) FILTER (rn <= 20) AS packet_refs, any_value(esp_packets) AS esp_packets, any_value(anti_replay) AS anti_replay
FROM orph JOIN rep USING (capture_id, peers) GROUP BY capture_id, peers""",
)
add(
    "ingest_summary",
    lambda spark, d: O.ingest_summary(_sa(spark, d), S.esp_packets(spark, d)),
    f"""WITH {ESP}, {IKE}, {SA_SQL} SELECT capture_id, count(*) AS session_count, string_agg(DISTINCT version, ',' ORDER BY version) AS ike_versions,
 count(*) FILTER (NOT complete) AS incomplete, count(*) FILTER (nat_traversal) AS nat_traversal,
 capture_id IN (SELECT capture_id FROM esp) AS has_esp FROM sa GROUP BY capture_id""",
)
add(
    "flagged_sessions",
    lambda spark, d: O.flagged_sessions(_sa(spark, d)),
    f"""WITH {IKE}, {SA_SQL} SELECT capture_id, init_spi, session_id, 'incomplete' AS flag FROM sa WHERE NOT complete
 UNION ALL SELECT capture_id, init_spi, session_id, 'nat_traversal' FROM sa WHERE nat_traversal""",
)
add(
    "evidence_frames",
    lambda spark, d: O.evidence_frames(S.ike_messages(spark, d)),
    f"WITH {IKE} SELECT capture_id, init_spi, frame, coalesce(length, 0) AS length FROM ike",
)
add(
    "capture_stats",
    lambda spark, d: O.capture_stats(S.ike_messages(spark, d), S.esp_packets(spark, d)),
    f"""WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL},
allp AS (SELECT capture_id, frame, t_us, 1 AS ike FROM ike UNION ALL SELECT capture_id, frame, t_us, 0 FROM esp),
seqd AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame, ike) AS up, row_number() OVER (PARTITION BY capture_id ORDER BY frame DESC, ike DESC) AS down FROM allp),
tot AS (SELECT capture_id, count(*) AS packets, sum(ike)::BIGINT AS ike_packets, greatest(max(t_us) FILTER (down = 1) - max(t_us) FILTER (up = 1), 0) AS duration_us FROM seqd GROUP BY 1),
s1 AS (SELECT capture_id, count(*) AS sas, count(*) FILTER (NOT complete) AS inc FROM sa GROUP BY 1),
o1 AS (SELECT capture_id, sum(pair_packets)::BIGINT AS orp, count(*) AS mid FROM owners WHERE owner IS NULL GROUP BY 1)
SELECT capture_id, packets, ike_packets, packets - ike_packets AS esp_packets, duration_us, coalesce(sas, 0) + coalesce(mid, 0) AS sessions,
 coalesce(inc, 0) + coalesce(mid, 0) AS incomplete_sessions, coalesce(orp, 0) AS orphan_esp_packets
FROM tot LEFT JOIN s1 USING (capture_id) LEFT JOIN o1 USING (capture_id)""",
)


def sa_flow(spark, d):
    """Busiest flow of every association, the zero vector where it owns no packet."""
    sa = _sa(spark, d)
    owned = O.own_packets(S.esp_packets(spark, d), sa).filter("owner IS NOT NULL")
    owned = owned.withColumn("spi_hex", FL.spi_key(F.col("spi")))
    keys = ["capture_id", "owner"]
    flows = FL.busiest_flow(FL.flow_features(owned, [*keys, "spi_hex"], keys), keys)
    keyed = sa.withColumn("owner", peer_pair(F.col("initiator_ip"), F.col("responder_ip")))
    facts = O.sa_pairs(sa).select(*keys, "sa_count").join(flows, keys, "left")
    joined = attach(keyed, facts, keys, "sa_count")
    seen = F.col("pkt_total").isNotNull()
    return joined.select(
        "capture_id", "init_spi", "session_id", seen.alias("has_esp"),
        F.when(~seen, FL.NO_ESP).otherwise("untrained").alias("model_version"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in FL.FEATURES],
    )


_OWNED_BASE = "ob AS (SELECT capture_id, owner, spi_hex, size, src, frame, t_us FROM owned WHERE owner IS NOT NULL)"
add(
    "sa_flow",
    sa_flow,
    f"""WITH {ESP}, {BASE}, {IKE}, {SA_SQL}, {OWNER_SQL}, {_OWNED_BASE}, {flow_cte(['capture_id', 'owner', 'spi_hex'], ['capture_id', 'owner'], 'ob')},
best AS (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY capture_id, owner ORDER BY pkt_total DESC, first_frame) = 1)
SELECT s.capture_id, s.init_spi, s.session_id, b.owner IS NOT NULL AS has_esp, CASE WHEN b.owner IS NULL THEN 'no-esp-observed' ELSE 'untrained' END AS model_version,
{', '.join(f'coalesce(b.{c}, 0) AS {c}' for c in FL.FEATURES)}
FROM sa s LEFT JOIN best b ON s.capture_id = b.capture_id AND b.owner = least(initiator_ip, responder_ip) || '|' || greatest(initiator_ip, responder_ip)""",
)
