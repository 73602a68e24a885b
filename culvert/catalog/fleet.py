"""Fleet rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.anomalies import EVENTS, stored_events
from culvert.catalog.rules import ASSESSED, COMPLIANCE, EXPO, FOUND, SESS, THREATS, assessed, compliance, exposed, found, q
from culvert.functions import ruletables as R
from culvert.operators import fleet as O
from culvert.operators import rules as RU
from culvert.plans import standins as S

A = f"WITH {ASSESSED}"
FD = f"WITH {ASSESSED}, {FOUND}"
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
ORANK = RANK.replace("CASE severity", "CASE overall_severity")
SEVS = "(VALUES (0, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW'), (4, 'SAFE')) AS s(rank, severity)"

add("posture", lambda s, d: O.posture(assessed(s, d)), f"{A} SELECT coalesce(round_even(avg(risk_score), 0), 100)::BIGINT AS posture_score FROM assessed")
add(
    "severity_counts",
    lambda s, d: O.severity_counts(assessed(s, d)),
    f"{A} SELECT s.rank, s.severity, count(a.row_no) AS sessions FROM {SEVS} LEFT JOIN assessed a ON a.overall_severity = s.severity GROUP BY ALL",
)
TOP = f"top AS (SELECT rule_id, severity, description, count(*) AS session_count FROM found GROUP BY rule_id, severity, description ORDER BY {RANK}, session_count DESC, rule_id LIMIT 3)"
add("top_findings", lambda s, d: O.top_findings(found(s, d)), f"{FD}, {TOP} SELECT * FROM top")
add(
    "top_finding_sessions",
    lambda s, d: O.top_finding_sessions(found(s, d)).select("rule_id", "row_no", "session_id"),
    f"{FD}, {TOP} SELECT rule_id, row_no, session_id FROM found WHERE rule_id IN (SELECT rule_id FROM top)",
)
ORDER_SQL = "CASE predicted_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(O.TRAFFIC_ORDER)) + " ELSE 7 END"
add(
    "traffic_mix",
    lambda s, d: O.traffic_mix(S.sessions(s, d)),
    f"WITH {SESS} SELECT predicted_type, count(*) AS sessions, {ORDER_SQL} AS position FROM sess WHERE model_version <> 'no-esp-observed' GROUP BY predicted_type",
)
add(
    "confidence_stats",
    lambda s, d: O.confidence_stats(S.sessions(s, d)),
    f"WITH {SESS} SELECT count(*) AS classified_count, count(*) FILTER (abstained) AS abstained_count, round_even(avg(round_even(confidence * 10000, 0)::BIGINT) / 10000 * 1000, 0)::DOUBLE / 1000 AS mean_ai_confidence FROM sess WHERE model_version <> 'no-esp-observed'",
)
add("threat_matrix", lambda s, d: O.threat_matrix(RU.threat_entries(found(s, d))), f"{FD}, {THREATS} SELECT DISTINCT threat, likelihood, impact FROM threats")
add(
    "threat_grid",
    lambda s, d: O.threat_grid(RU.threat_entries(found(s, d))),
    f"""{FD}, {THREATS}, lv AS (SELECT * FROM (VALUES ('High'), ('Med'), ('Low')) AS v(l)), c AS (SELECT a.l AS likelihood, b.l AS impact, count(t.threat) AS count, count(DISTINCT t.threat) AS threats
 FROM lv a CROSS JOIN lv b LEFT JOIN threats t ON t.likelihood = a.l AND t.impact = b.l GROUP BY ALL), m AS (SELECT *, count / (max(count) OVER ())::DOUBLE AS share FROM c)
 SELECT likelihood, impact, count, threats, CASE WHEN count = 0 THEN 0 WHEN share > 0.8 THEN 1 WHEN share > 0.6 THEN 2 WHEN share > 0.4 THEN 3 WHEN share > 0.2 THEN 4 ELSE 5 END AS step FROM m""",
)
add("all_findings", lambda s, d: found(s, d).select("session_id", "rule_id", "severity"), f"{FD} SELECT session_id, rule_id, severity FROM found")
add(
    "fleet_exposure",
    lambda s, d: O.fleet_exposure(exposed(s, d)),
    f"WITH {SESS}, {EXPO} SELECT coalesce(round_even(avg(exposure_score), 0), 0)::BIGINT AS mean_score, count(*) FILTER (exposure_level = 'High') AS level_high, count(*) FILTER (exposure_level = 'Med') AS level_med, count(*) FILTER (exposure_level = 'Low') AS level_low FROM exps",
)
add("leaking_signals", lambda s, d: O.leaking_signals(exposed(s, d)), f"WITH {SESS}, {EXPO} SELECT signal, count(*) AS sessions FROM sig WHERE level IN ('High', 'Med') GROUP BY signal")
add(
    "compliance_rollup",
    lambda s, d: O.compliance_rollup(compliance(s, d)),
    f"{A}, {COMPLIANCE} SELECT baseline_id, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'not_assessed') AS not_assessed FROM comp GROUP BY 1",
)
add(
    "common_violations",
    lambda s, d: O.common_violations(compliance(s, d)),
    f"""{A}, {COMPLIANCE}, v AS (SELECT baseline_id, unnest(string_split(violations, ';')) AS violation FROM comp WHERE violations <> ''), c AS (SELECT baseline_id, violation, count(*) AS sessions FROM v GROUP BY ALL)
 SELECT baseline_id, violation, sessions, row_number() OVER (PARTITION BY baseline_id ORDER BY sessions DESC, violation)::INTEGER AS position FROM c QUALIFY position <= 5""",
)
add("pqc_readiness", lambda s, d: O.pqc_readiness(S.sessions(s, d)), f"WITH {SESS} SELECT pqc_status, count(*) AS sessions FROM sess GROUP BY 1")


def _summary(s, d):
    return O.summary(RU.exposure(assessed(s, d)))


SUMMARY = """sm AS (SELECT count(*) AS session_count, coalesce(round_even(avg(risk_score), 0), 100)::BIGINT AS posture_score, count(*) FILTER (overall_severity = 'CRITICAL') AS critical,
 count(*) FILTER (overall_severity = 'HIGH') AS high, count(*) FILTER (overall_severity = 'MEDIUM') AS medium, count(*) FILTER (overall_severity = 'LOW') AS low, count(*) FILTER (overall_severity = 'SAFE') AS safe,
 (SELECT coalesce(round_even(avg(exposure_score), 0), 0)::BIGINT FROM exps) AS mean_exposure, count(*) FILTER (pqc_status = 'hybrid') AS pqc_hybrid, count(*) FILTER (pqc_status = 'classical') AS pqc_classical,
 count(*) FILTER (pqc_status = 'unknown') AS pqc_unknown, count(*) FILTER (model_version <> 'no-esp-observed') AS classified_count, count(*) FILTER (model_version <> 'no-esp-observed' AND abstained) AS abstained_count,
 round_even(avg(round_even(confidence * 10000, 0)::BIGINT) FILTER (model_version <> 'no-esp-observed') / 10000 * 1000, 0)::DOUBLE / 1000 AS mean_ai_confidence FROM assessed)"""
add("fleet_summary", _summary, f"{A}, {EXPO}, {SUMMARY} SELECT * FROM sm")
add(
    "fleet_verdict",
    lambda s, d: O.with_verdict(_summary(s, d)),
    f"""{A}, {EXPO}, {SUMMARY}, o AS (SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'SAFE' END AS overall_severity FROM sm)
 SELECT session_count, overall_severity, CASE WHEN session_count = 0 THEN 'The capture holds no tunnels.' WHEN overall_severity = 'SAFE' THEN 'All ' || session_count || ' tunnels meet the baseline.'
 ELSE (CASE WHEN critical > 0 THEN critical ELSE high END) || ' of ' || session_count || ' tunnels have ' || CASE WHEN critical > 0 THEN 'critical' ELSE 'high-severity' END || ' weaknesses.' END AS verdict FROM o""",
)
add(
    "action_list",
    lambda s, d: O.actions(found(s, d)),
    f"{FD}, {TOP} SELECT rule_id, description || ': change the configuration of ' || session_count || CASE WHEN session_count = 1 THEN ' tunnel.' ELSE ' tunnels.' END AS action FROM top",
)
PAGE = "CASE " + " ".join(f"WHEN contains(standard, {q(k)}) THEN {q(u)}" for k, u in R.STANDARD_PAGES) + " END"
add(
    "finding_links",
    lambda s, d: O.finding_links(found(s, d)),
    f"{FD} SELECT DISTINCT rule_id, standard, cve, 'https://nvd.nist.gov/vuln/detail/' || cve AS cve_url, {PAGE} AS standard_url FROM found",
)
add("event_ranking", lambda s, d: O.rank_events(stored_events(s, d)).select("anomaly_id", "anomaly_type", "severity", "t_us"), f"WITH {SESS}, {EVENTS} SELECT anomaly_id, anomaly_type, severity, t_us FROM ev")
GLOSS = "CASE anomaly_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.ANOMALY_GLOSS.items()) + " END"
add(
    "event_kinds",
    lambda s, d: O.event_kinds(stored_events(s, d)),
    f"WITH {SESS}, {EVENTS} SELECT anomaly_type, min({RANK})::INTEGER AS rank, count(*) AS events, {GLOSS} AS meaning FROM ev GROUP BY anomaly_type",
)
SEV_GLOSS = "CASE overall_severity " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.SEVERITY_GLOSS.items()) + " END"
add(
    "severity_gloss",
    lambda s, d: assessed(s, d).select("row_no", "overall_severity", O.gloss(F.col("overall_severity"), R.SEVERITY_GLOSS).alias("meaning")),
    f"{A} SELECT row_no, overall_severity, {SEV_GLOSS} AS meaning FROM assessed",
)
add(
    "risk_histogram",
    lambda s, d: O.risk_histogram(assessed(s, d)),
    f"{A}, b AS (SELECT range AS bin FROM range(10)) SELECT bin::INTEGER AS bin, (bin * 10) || '-' || (bin * 10 + 9) AS band, count(row_no) AS sessions FROM b LEFT JOIN assessed ON least(9, risk_score // 10) = bin GROUP BY bin",
)
ADDR = "initiator_ip <> '' AND responder_ip <> ''"
ENDS = f"ends AS (SELECT initiator_ip AS peer, overall_severity FROM assessed WHERE {ADDR} UNION ALL SELECT responder_ip, overall_severity FROM assessed WHERE {ADDR})"
add(
    "peer_nodes",
    lambda s, d: O.peer_nodes(assessed(s, d)),
    f"{A}, {ENDS}, r AS (SELECT peer, min({ORANK}) AS rank, count(*) AS sessions FROM ends GROUP BY peer) SELECT peer, s.severity, sessions FROM r JOIN {SEVS} ON r.rank = s.rank",
)
add("peer_edges", lambda s, d: O.peer_edges(assessed(s, d)), f"{A} SELECT initiator_ip AS source, responder_ip AS target, session_id, overall_severity AS severity FROM assessed WHERE {ADDR}")
add("distinct_peers", lambda s, d: O.distinct_peers(S.sessions(s, d)), f"WITH {SESS} SELECT initiator_ip AS peer FROM sess WHERE initiator_ip <> '' UNION SELECT responder_ip FROM sess WHERE responder_ip <> ''")
V4 = "CASE WHEN regexp_matches(initiator_ip, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN ((split_part(initiator_ip, '.', 1)::BIGINT * 256 + split_part(initiator_ip, '.', 2)::BIGINT) * 256 + split_part(initiator_ip, '.', 3)::BIGINT) * 256 + split_part(initiator_ip, '.', 4)::BIGINT END"
for _key, _sql in {"risk": f"{ORANK}, risk_score", "cipher": "encryption", "peer": f"{V4} NULLS FIRST, initiator_ip", "version": "version"}.items():
    add(
        f"sorted_page_by_{_key}",
        (lambda k: lambda s, d: O.page(O.sort_sessions(assessed(s, d), k), 3, 25).select("row_no", "session_id", "risk_score"))(_key),
        f"{A} SELECT row_no, session_id, risk_score FROM assessed ORDER BY {_sql}, row_no LIMIT 25 OFFSET 75",
    )
    if _key in ("risk", "peer"):
        add(
            f"session_places_by_{_key}",
            (lambda k: lambda s, d: O.PageIndex(assessed(s, d), O.sort_order(k)).pages(25).select("row_no", "session_id", "place", "page"))(_key),
            f"{A} SELECT row_no, session_id, row_number() OVER o - 1 AS place, (row_number() OVER o - 1) // 25 AS page FROM assessed WINDOW o AS (ORDER BY {_sql}, row_no)",
        )
NEEDLES = ("encryption", "substr(dh_group, 1, 2)", "vendor", "substr(initiator_ip, 4)", "substr(responder_ip, 1, 1)", "right(session_id, 5)", "' ' || upper(vendor) || 'x'")


def needle_hits(s, d):
    """Every value that these fields take, and parts of them, sought in all sessions at once."""
    rows = assessed(s, d)
    fields = rows.select("ike.encryption", "ike.dh_group", "ike.vendor", "initiator_ip", "responder_ip", "session_id")
    needles = fields.select(F.explode(F.array(*[F.expr(n) for n in NEEDLES])).alias("needle")).filter("needle IS NOT NULL").distinct()
    hits = O.SearchIndex(rows, "row_no").find(needles)
    return hits.groupBy("needle").agg(F.count("*").alias("hits"), F.min("row_id").alias("first_row"), F.sum("row_id").alias("row_sum"))


add(
    "search_hits",
    needle_hits,
    f"""{A}, needles AS (SELECT DISTINCT unnest([{', '.join(NEEDLES)}]) AS needle FROM assessed),
    t AS (SELECT row_no, lower(concat_ws(' ', session_id, initiator_ip, responder_ip, encryption, dh_group, vendor, predicted_type)) AS text FROM assessed),
    u AS (SELECT text, count(*) AS n, min(row_no) AS first_row, sum(row_no) AS row_sum FROM t GROUP BY text)
    SELECT needle, sum(n)::BIGINT AS hits, min(first_row) AS first_row, sum(row_sum)::BIGINT AS row_sum FROM needles JOIN u ON contains(text, lower(trim(needle))) WHERE needle IS NOT NULL GROUP BY needle""",
)
add(
    "session_search",
    lambda s, d: O.filter_sessions(assessed(s, d), version="IKEv2", peer="192.168.0.1", search=" cisco ").select("row_no", "session_id"),
    f"{A} SELECT row_no, session_id FROM assessed WHERE version = 'IKEv2' AND contains(initiator_ip || ' ' || responder_ip, '192.168.0.1') AND contains(lower(concat_ws(' ', session_id, initiator_ip, responder_ip, encryption, dh_group, vendor, predicted_type)), 'cisco')",
)
add(
    "severity_filter",
    lambda s, d: O.filter_sessions(assessed(s, d), severity="HIGH").select("row_no", "session_id"),
    f"{A} SELECT row_no, session_id FROM assessed WHERE overall_severity = 'HIGH'",
)
add("page_count", lambda s, d: O.page_count(S.sessions(s, d), 25), f"WITH {SESS} SELECT greatest(1, ceil(count(*) / 25.0))::BIGINT AS pages FROM sess")
add(
    "worst_severity",
    lambda s, d: O.worst_severity(assessed(s, d)),
    f"{A}, c AS (SELECT {ORANK} AS rank, overall_severity AS sev, count(*) AS n FROM assessed GROUP BY ALL) SELECT arg_min(sev, rank) AS worst, string_agg(sev || '=' || n, ',' ORDER BY rank) AS tally FROM c",
)
