"""Anomaly queries over the session stand-in."""

from __future__ import annotations

from culvert.catalog import add
from culvert.catalog.rules import SESS
from culvert.operators import anomalies as O
from culvert.plans import standins as S
from culvert.session import materialise

EV = "array_to_string(packet_refs, ',')"
NS = "from_hex('6ba7b8129dad11d180b400c04fd430c8')"


def uuid_sql(kind: str, ev: str, text: str) -> str:
    h = f"sha1({NS} || encode('{kind}' || '|' || session_id || '|' || {ev} || '|' || {text}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', ((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4)::INT + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


def event_sql(kind: str, severity: str, text: str, ev: str = EV, t: str = "t_us") -> str:
    return (
        f"SELECT {uuid_sql(kind, ev, text)} AS anomaly_id, job_id, session_id, {t} AS t_us, '{kind}' AS anomaly_type, "
        f"{severity} AS severity, {text} AS description, {ev} AS evidence"
    )


WEAK = "(contains(lower(encryption), 'des') OR contains(lower(encryption), 'null') OR regexp_matches(lower(dh_group), 'modp768|modp1024|modp1536|group 1|group 2|group 5'))"
OBS = "encryption <> 'unknown' AND dh_group <> 'unknown'"
PAIR = "job_id, initiator_ip, responder_ip"
OCT = "split_part(initiator_ip, '.', {})::INT"
PUBLIC = f"""CASE WHEN regexp_matches(initiator_ip, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN NOT (
 starts_with(initiator_ip, '10.') OR starts_with(initiator_ip, '192.168.') OR ({OCT.format(1)} = 172 AND {OCT.format(2)} BETWEEN 16 AND 31) OR {OCT.format(1)} IN (0, 127) OR {OCT.format(1)} >= 240)
 WHEN contains(initiator_ip, ':') THEN starts_with(initiator_ip, '2a00:') ELSE FALSE END"""
PARTS = {
    "aggressive_probe": f"""ag AS (SELECT *, count(*) OVER (PARTITION BY job_id, responder_ip) AS n FROM sess WHERE version = 'IKEv1' AND aggressive_mode),
e1 AS ({event_sql('AGGRESSIVE_MODE_PROBE', "CASE WHEN n >= 3 THEN 'CRITICAL' ELSE 'HIGH' END", "CASE WHEN n >= 3 THEN n || ' Aggressive Mode exchanges aimed at ' || responder_ip ELSE 'Aggressive Mode exchange exposes a password hash at ' || responder_ip END")} FROM ag)""",
    "transform_bruteforce": f"""bf AS (SELECT {PAIR}, count(DISTINCT (encryption, integrity, dh_group)) AS n FROM sess WHERE {OBS} GROUP BY ALL),
e2 AS ({event_sql('TRANSFORM_BRUTEFORCE', "'HIGH'", "n || ' different suites from ' || initiator_ip || ' to ' || responder_ip")} FROM sess JOIN bf USING ({PAIR}) WHERE {OBS} AND n >= 4)""",
    "spi_collision": f"""co AS (SELECT job_id, session_id, count(DISTINCT (initiator_ip, responder_ip)) AS n FROM sess GROUP BY ALL HAVING n > 1),
fr AS (SELECT DISTINCT job_id, session_id, unnest(packet_refs) AS frame FROM sess),
fe AS (SELECT job_id, session_id, count(*) || ':' || min(frame) || ':' || max(frame) || ':' || sum(frame) AS ev FROM fr GROUP BY ALL),
e3 AS ({event_sql('SPI_COLLISION', "'CRITICAL'", "'identifier ' || session_id || ' used between ' || n || ' peer pairs'", 'ev', 'NULL::BIGINT')} FROM co JOIN fe USING (job_id, session_id))""",
    "downgrade": f"""dg AS (SELECT {PAIR} FROM sess WHERE {OBS} GROUP BY ALL HAVING bool_or({WEAK}) AND bool_or(NOT {WEAK})),
e4 AS ({event_sql('DOWNGRADE_SUSPECTED', "'HIGH'", "initiator_ip || ' agreed on ' || encryption || ' / ' || dh_group || ' with ' || responder_ip || ' although both can do better'")} FROM sess JOIN dg USING ({PAIR}) WHERE {OBS} AND {WEAK})""",
    "nat_t_unexpected": f"""e5 AS ({event_sql('NAT_T_UNEXPECTED', "'MEDIUM'", "'NAT traversal from public address ' || initiator_ip")} FROM sess WHERE nat_traversal AND {PUBLIC})""",
    "rekey_storm": f"""rs AS (SELECT {PAIR}, count(*) AS n, max(t_us) - min(t_us) AS span FROM sess WHERE t_us IS NOT NULL GROUP BY ALL HAVING count(*) >= 4 AND max(t_us) - min(t_us) <= 60000000),
e6 AS ({event_sql('REKEY_STORM', "'MEDIUM'", "n || ' associations ' || initiator_ip || '->' || responder_ip || ' in ' || (span // 1000000) || ' s'")} FROM sess JOIN rs USING ({PAIR}) WHERE t_us IS NOT NULL)""",
}
KIND = {
    "aggressive_probe": "AGGRESSIVE_MODE_PROBE", "transform_bruteforce": "TRANSFORM_BRUTEFORCE", "downgrade": "DOWNGRADE_SUSPECTED",
    "nat_t_unexpected": "NAT_T_UNEXPECTED", "rekey_storm": "REKEY_STORM",
}


def _one(name):
    if name == "spi_collision":
        return lambda spark, d: O.spi_collision(S.sessions(spark, d))
    return lambda spark, d: O.member_events(S.sessions(spark, d), kinds=(KIND[name],))


for i, (name, cte) in enumerate(PARTS.items(), 1):
    add(name, _one(name), f"WITH {SESS}, {cte} SELECT * FROM e{i}")

EVENTS = ", ".join(PARTS.values()) + ", ev AS (" + " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(1, 7)) + ")"
add("all_anomalies", lambda spark, d: O.detect(S.sessions(spark, d)), f"WITH {SESS}, {EVENTS} SELECT * FROM ev")
EVIDENCE = """evf AS (SELECT anomaly_type, job_id, session_id, unnest(string_split(evidence, ','))::BIGINT AS frame FROM ev WHERE anomaly_type <> 'SPI_COLLISION'
 UNION ALL SELECT 'SPI_COLLISION', job_id, session_id, frame FROM fr JOIN co USING (job_id, session_id))"""


def stored_events(spark, d):
    """Events written once to the shared folder, as an analysis stores them, then read back."""
    return materialise(O.detect(S.sessions(spark, d)), "events")


def _fold(spark, d):
    s = S.sessions(spark, d)
    events = stored_events(spark, d)
    return O.fold_by_type(events, O.evidence_rows(events, s))


add(
    "anomaly_groups",
    _fold,
    f"""WITH {SESS}, {EVENTS}, {EVIDENCE}, a AS (SELECT anomaly_type, CASE min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 count(*) AS events, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1), b AS (SELECT anomaly_type, count(DISTINCT frame) AS frames, min(frame) AS first_frame, max(frame) AS last_frame FROM evf GROUP BY 1)
 SELECT anomaly_type, severity, events, sessions, coalesce(frames, 0) AS frames, first_frame, last_frame FROM a LEFT JOIN b USING (anomaly_type)""",
)
add(
    "spi_collision_evidence",
    lambda spark, d: O.spi_collision_evidence(S.sessions(spark, d)),
    f"WITH {SESS}, {EVENTS} SELECT job_id, session_id, frame FROM fr JOIN co USING (job_id, session_id)",
)
