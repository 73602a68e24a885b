"""Export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.anomalies import EVENTS, stored_events
from culvert.catalog.rules import ASSESSED, FOUND, assessed
from culvert.operators import exports as O
from culvert.operators import ledger as L
from culvert.operators import rules as RU
from culvert.plans import standins as S


def _documents(s, d):
    stored = L.latest_records(assessed(s, d), ("job_id", "session_id"))
    fields = ["session_id", "initiator_ip", "responder_ip", "risk_score", "overall_severity", "triggered_rules"]
    return O.session_documents(stored, stored_events(s, d), [F.col(f) for f in fields])


add(
    "json_documents",
    _documents,
    f"""WITH {ASSESSED}, {EVENTS}, st AS (SELECT * FROM assessed QUALIFY row_number() OVER (PARTITION BY job_id, session_id ORDER BY created_us DESC, row_no DESC) = 1)
SELECT job_id, session_id, 'session' AS kind, to_json({{'session_id': session_id, 'initiator_ip': initiator_ip, 'responder_ip': responder_ip, 'risk_score': risk_score, 'overall_severity': overall_severity,
 'triggered_rules': CASE WHEN triggered_rules = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(triggered_rules, ',') END}})::VARCHAR AS document FROM st
UNION ALL SELECT job_id, session_id, 'anomaly' AS kind, to_json({{'session_id': session_id, 'anomaly_id': anomaly_id, 'anomaly_type': anomaly_type, 'severity': severity, 'description': description, 't_us': t_us}})::VARCHAR AS document
FROM ev SEMI JOIN st USING (job_id, session_id)""",
)


def ext(v: str) -> str:
    return f"replace(replace(replace({v}, '\\', '\\\\'), '=', '\\='), chr(10), ' ')"


def kv(key: str, v: str) -> str:
    return f"CASE WHEN {v} <> '' THEN '{key}=' || {ext(v)} END"


HEAD = "'CEF:0|Culvert|Tunnel Analytics|1.0|'"
SESSION_EXT = ", ".join([
    kv("src", "initiator_ip"), kv("dst", "responder_ip"), "'cs1Label=sessionId'", kv("cs1", "session_id"), "'cs2Label=ikeVersion'", kv("cs2", "version"),
    "'cs3Label=encryption'", kv("cs3", "encryption"), "'cs4Label=dhGroup'", kv("cs4", "dh_group"), "'cn1Label=riskScore'", "'cn1=' || risk_score", "'cs5Label=trafficType'",
    kv("cs5", "(CASE WHEN model_version = 'no-esp-observed' THEN '' ELSE predicted_type END)"), "'rt=' || (t_us // 1000)",
])
SEVN = "CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 3 ELSE 0 END"
add(
    "cef_lines",
    lambda s, d: O.cef_lines(assessed(s, d), RU.finding_structs(), stored_events(s, d)),
    f"""WITH {ASSESSED}, {FOUND}, {EVENTS}, fj AS (SELECT a.*, f.rule_id, f.severity, f.description, f.cve, f.standard, f.inferred_from FROM assessed a JOIN found f USING (row_no)),
ends AS (SELECT job_id, session_id, arg_max(initiator_ip, row_no) AS si, arg_max(responder_ip, row_no) AS sr FROM sess GROUP BY ALL)
SELECT job_id, session_id, {HEAD} || 'CLEAN|No findings|0|' || concat_ws(' ', {SESSION_EXT}) AS line FROM assessed WHERE triggered_rules = ''
UNION ALL SELECT job_id, session_id, {HEAD} || rule_id || '|' || description || '|' || {SEVN} || '|' || concat_ws(' ', {SESSION_EXT}, 'cs6Label=standard', {kv('cs6', 'standard')},
 CASE WHEN inferred_from <> '' THEN 'flexString1Label=inferredFields' END, {kv('flexString1', 'inferred_from')}, {kv('cve', 'cve')}) FROM fj
UNION ALL SELECT ev.job_id, ev.session_id, {HEAD} || anomaly_type || '|' || description || '|' || {SEVN} || '|' || concat_ws(' ', {kv('src', 'si')}, {kv('dst', 'sr')}, 'cs1Label=sessionId', {kv('cs1', 'ev.session_id')},
 'cs6Label=evidenceFrames', {kv('cs6', 'evidence')}, 'rt=' || (t_us // 1000)) FROM ev LEFT JOIN ends USING (job_id, session_id)""",
)
