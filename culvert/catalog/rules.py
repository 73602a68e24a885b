"""Rule, compliance, exposure and what-if queries over the session stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.functions import ruletables as R
from culvert.operators import rules as O
from culvert.plans import standins as S

SESS = S.duck_cte("sess")


def q(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def fired_sql(src: str = "sess", name: str = "fired") -> str:
    """Booleans r01..r21, spelled out without the rule table."""
    rx = lambda col, pat: f"coalesce(regexp_matches({col}, '{pat}', 'i'), FALSE)"
    v1 = "version = 'IKEv1'"
    conds = {
        "r01": rx("encryption", r"^(des|null)\b"), "r02": rx("encryption", "^3des"), "r03": rx("dh_group", r"modp768|\bgroup ?1\b"),
        "r04": rx("dh_group", r"modp1024|\bgroup ?2\b"), "r05": rx("dh_group", r"modp1536|\bgroup ?5\b"),
        "r06": f"coalesce({v1} AND aggressive_mode AND auth_method = 'PSK', FALSE)", "r07": f"({v1})", "r08": rx("integrity", "md5"),
        "r09": rx("integrity", r"sha-?1(\b|$)"), "r10": "pfs_status = 'disabled'", "r11": "coalesce(sa_lifetime_sec > 86400, FALSE)",
        "r12": "coalesce(sa_lifetime_sec > 28800, FALSE)", "r13": f"coalesce(auth_method = 'PSK', FALSE) AND {rx('dh_group', 'modp(768|1024|1536)')}",
        "r14": f"fragmented_ike AND {rx('vendor', 'cisco')}", "r15": "coalesce(anti_replay = FALSE, FALSE)", "r16": "coalesce(cert_expired, FALSE)",
        "r17": "dpd_status = 'disabled'", "r18": f"({v1} AND ip_version = 'IPv6')", "r19": f"({v1} AND aggressive_mode)",
        "r20": "pqc_status = 'classical'", "r21": "len(gateway_mismatches) > 0",
    }
    return f"{name} AS (SELECT *, " + ", ".join(f"{c} AS {k}" for k, c in conds.items()) + f" FROM {src})"


CRIT = ("r01", "r03", "r04", "r06", "r08", "r16")
HIGH = ("r02", "r05", "r07", "r09", "r13", "r14", "r15")
MED = ("r10", "r11", "r19", "r21")
LOW = ("r12", "r17", "r18")
SCORE = "greatest(0, 100 - (" + " + ".join(f"{w} * {r}::INT" for w, rs in ((40, CRIT), (20, HIGH), (10, MED), (5, LOW)) for r in rs) + "))::BIGINT"
WORST = "CASE " + " ".join(f"WHEN {' OR '.join(rs)} THEN '{s}'" for s, rs in (("CRITICAL", CRIT), ("HIGH", HIGH), ("MEDIUM", MED), ("LOW", LOW))) + " ELSE 'SAFE' END"
ALL = [f"r{i:02d}" for i in range(1, 22)]
TRIG = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} THEN '{r.upper()}' END" for r in ALL) + ")"
SEV_OF = {**{r: "CRITICAL" for r in CRIT}, **{r: "HIGH" for r in HIGH}, **{r: "MEDIUM" for r in MED}, **{r: "LOW" for r in LOW}, "r20": "LOW"}
ASSESSED = f"{SESS}, {fired_sql()}, assessed AS (SELECT *, {SCORE} AS risk_score, {WORST} AS overall_severity, {TRIG} AS triggered_rules FROM fired)"
FIELDS = {"r01": "encryption", "r02": "encryption", "r03": "dh_group", "r04": "dh_group", "r05": "dh_group", "r13": "dh_group"}
META = {r["id"].lower(): r for r in R.RULES}
FOUND = "found AS (" + " UNION ALL ".join(
    f"SELECT job_id, row_no, session_id, vendor, '{r.upper()}' AS rule_id, '{SEV_OF[r]}' AS severity, {q(META[r]['description'])} AS description, "
    f"{q(META[r]['cve'])}::VARCHAR AS cve, {q(META[r]['standard'])} AS standard, "
    + (f"CASE WHEN list_contains(inferred_fields, '{FIELDS[r]}') THEN '{FIELDS[r]}' ELSE '' END" if r in FIELDS else "''")
    + f" AS inferred_from FROM fired WHERE {r}"
    for r in ALL
) + ")"
KEEP = ["job_id", "row_no", "session_id"]


def assessed(spark, d):
    return O.assess(S.sessions(spark, d))


def found(spark, d):
    return O.findings(assessed(spark, d).withColumn("vendor", F.col("ike.vendor")), [*KEEP, "vendor"])


add(
    "risk_assessment",
    lambda spark, d: assessed(spark, d).select(*KEEP, "risk_score", "overall_severity", F.array_join("triggered_rules", ",").alias("triggered_rules")),
    f"WITH {ASSESSED} SELECT job_id, row_no, session_id, risk_score, overall_severity, triggered_rules FROM assessed",
)
add(
    "findings",
    lambda spark, d: found(spark, d).withColumn("inferred_from", F.array_join("inferred_from", ",")),
    f"WITH {ASSESSED}, {FOUND} SELECT * FROM found",
)
KEY_SQL = "CASE " + " ".join(f"WHEN contains(lower(vendor), '{n}') THEN '{k}'" for n, k in R.VENDOR_KEYS) + " ELSE 'generic' END"
GROUP_SQL = "CASE rule_id " + " ".join(f"WHEN '{r['id']}' THEN '{r['group']}' END".replace(" END", "") for r in R.RULES) + " END"
TEMPLATES = "tpl(grp, vendor_key, text) AS (VALUES " + ", ".join(f"({q(g)}, {q(v)}, {q(t)})" for g, vs in R.templates().items() for v, t in vs.items()) + ")"
add(
    "remediation",
    lambda spark, d: O.with_remediation(found(spark, d), F.col("vendor")).select(*KEEP, "rule_id", "vendor_key", "remediation"),
    f"""WITH {ASSESSED}, {FOUND}, {TEMPLATES}, k AS (SELECT *, {KEY_SQL} AS vendor_key, {GROUP_SQL} AS grp FROM found)
SELECT job_id, row_no, session_id, rule_id, k.vendor_key, coalesce(a.text, b.text, {q(R.FALLBACK)}) AS remediation FROM k
LEFT JOIN tpl a ON a.grp = k.grp AND a.vendor_key = k.vendor_key LEFT JOIN tpl b ON b.grp = k.grp AND b.vendor_key = 'generic'""",
)
GRADE = "CASE severity WHEN 'CRITICAL' THEN 'High' WHEN 'HIGH' THEN 'Med' WHEN 'MEDIUM' THEN 'Med' ELSE 'Low' END AS likelihood, CASE severity WHEN 'CRITICAL' THEN 'High' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Med' ELSE 'Low' END AS impact"
THREATS = f"threats AS (SELECT *, description AS threat, {GRADE} FROM found)"
add(
    "threat_entries",
    lambda spark, d: O.threat_entries(found(spark, d)).select(*KEEP, "rule_id", "threat", "likelihood", "impact"),
    f"WITH {ASSESSED}, {FOUND}, {THREATS} SELECT job_id, row_no, session_id, rule_id, threat, likelihood, impact FROM threats",
)


def _baseline_sql(name: str, rules: str, req: list[tuple[str, str, str]]) -> str:
    bad = [f"CASE WHEN {r} THEN '{r.upper()}' END" for r in rules.split()]
    un = []
    for col, pat, label in req:
        un.append(f"CASE WHEN coalesce({col}, 'unknown') = 'unknown' THEN '{label}' END")
        bad.append(f"CASE WHEN coalesce({col}, 'unknown') <> 'unknown' AND NOT regexp_matches({col}, '{pat}', 'i') THEN 'requires {label}' END")
    unx = f"concat_ws(';', {', '.join(un)})" if un else "''"
    return f"SELECT job_id, row_no, session_id, '{name}' AS baseline_id, concat_ws(';', {', '.join(bad)}) AS violations, {unx} AS unassessed FROM fired"


_r = lambda *n: " ".join(f"r{i:02d}" for i in n)
COMPLIANCE = "comp0 AS (" + " UNION ALL ".join([
    _baseline_sql("NIST-800-77r1", _r(*range(1, 12), 13, 15, 16, 19, 21), []),
    _baseline_sql("NIST-800-131A", _r(1, 2, 3, 4, 5, 8, 16), []),
    _baseline_sql("BSI-TR-02102-3", _r(*range(1, 12), 13, 15, 16, 19), [("encryption", "^AES", "AES cipher"), ("dh_group", "MODP(3072|4096|6144|8192)|ECP(256|384|521)|BRAINPOOL|ML-KEM", "strong key exchange group")]),
    _baseline_sql("CNSA-2.0", _r(*range(1, 12), 13, 15, 16, 19, 20), [("encryption", "AES-256", "AES-256")]),
    _baseline_sql("CERT-IN", _r(1, 2, 3, 4, 6, 8, 14, 16), []),
    _baseline_sql("TEC-ITSAR", _r(*range(1, 10), 15, 16), []),
]) + "), comp AS (SELECT *, CASE WHEN violations <> '' THEN 'fail' WHEN unassessed <> '' THEN 'not_assessed' ELSE 'pass' END AS status FROM comp0)"


def compliance(spark, d):
    return O.compliance(assessed(spark, d), KEEP)


add(
    "compliance",
    lambda spark, d: compliance(spark, d).withColumns({c: F.array_join(c, ";") for c in ("violations", "unassessed")}),
    f"WITH {ASSESSED}, {COMPLIANCE} SELECT job_id, row_no, session_id, baseline_id, violations, unassessed, status FROM comp",
)
PCT = "(round_even(confidence * 100.0::DOUBLE, 0)::BIGINT)"
EXPO = f"""
expo AS (SELECT *, CASE WHEN pkt_total > 0 AND predicted_type <> 'Other' THEN CASE WHEN abstained OR confidence < 0.5 THEN 'Low' WHEN confidence >= 0.8 THEN 'High' ELSE 'Med' END END AS l_traffic,
 CASE WHEN (version = 'IKEv1' AND aggressive_mode) OR coalesce(cert_subject, '') <> '' THEN 'High' END AS l_identity,
 CASE WHEN coalesce(vendor, '') NOT IN ('', 'unknown') THEN 'Med' END AS l_implementation,
 CASE WHEN initiator_ip <> '' AND responder_ip <> '' THEN 'Low' END AS l_endpoints, CASE WHEN pkt_total > 0 THEN 'Low' END AS l_timing FROM sess),
sig AS (SELECT job_id, row_no, session_id, 'traffic_type' AS signal, l_traffic AS level, CASE WHEN l_traffic = 'Low' THEN 'best guess only, ' || {PCT} || '%' ELSE predicted_type || ' recognisable from packet sizes and timing, ' || {PCT} || '%' END AS detail FROM expo WHERE l_traffic IS NOT NULL
 UNION ALL SELECT job_id, row_no, session_id, 'identity', l_identity, CASE WHEN version = 'IKEv1' AND aggressive_mode THEN 'identity sent in the clear by Aggressive Mode' ELSE 'certificate subject readable: ' || cert_subject END FROM expo WHERE l_identity IS NOT NULL
 UNION ALL SELECT job_id, row_no, session_id, 'implementation', l_implementation, 'gateway recognisable as ' || vendor FROM expo WHERE l_implementation IS NOT NULL
 UNION ALL SELECT job_id, row_no, session_id, 'endpoints', l_endpoints, 'addresses visible: ' || initiator_ip || ' ' || responder_ip FROM expo WHERE l_endpoints IS NOT NULL
 UNION ALL SELECT job_id, row_no, session_id, 'timing', l_timing, pkt_total || ' packets in ' || round_even(duration_half_sec / 2.0::DOUBLE, 0)::BIGINT || ' s, ' || (rate_tenths // 10) || '.' || (rate_tenths % 10) || '/s' FROM expo WHERE l_timing IS NOT NULL),
exps AS (SELECT e.job_id, e.row_no, e.session_id, least(100, coalesce(sum(CASE level WHEN 'High' THEN 35 WHEN 'Med' THEN 20 WHEN 'Low' THEN 5 END), 0))::BIGINT AS exposure_score,
 coalesce(CASE min(CASE level WHEN 'High' THEN 0 WHEN 'Med' THEN 1 WHEN 'Low' THEN 2 END) WHEN 0 THEN 'High' WHEN 1 THEN 'Med' END, 'Low') AS exposure_level, count(level) AS signals
 FROM sess e LEFT JOIN sig s ON e.row_no = s.row_no GROUP BY ALL)"""


def exposed(spark, d):
    return O.exposure(S.sessions(spark, d))


add(
    "exposure_signals",
    lambda spark, d: exposed(spark, d).select(*KEEP, F.explode("exposure_signals").alias("s")).select(*KEEP, "s.*"),
    f"WITH {SESS}, {EXPO} SELECT * FROM sig",
)
add(
    "exposure_score",
    lambda spark, d: exposed(spark, d).select(*KEEP, "exposure_score", "exposure_level", F.size("exposure_signals").cast("bigint").alias("signals")),
    f"WITH {SESS}, {EXPO} SELECT * FROM exps",
)

OVERRIDE = {
    "encryption": "CASE WHEN row_no % 2 = 0 THEN 'AES-256-GCM' END",
    "dh_group": "CASE WHEN row_no % 3 = 0 THEN 'ECP384' END",
    "version": "CASE WHEN row_no % 5 = 0 THEN 'IKEv2' WHEN row_no % 5 = 1 THEN 'IKEv1' END",
    "aggressive_mode": "CASE WHEN row_no % 7 = 0 THEN FALSE END",
    "pqc_status": "CASE WHEN row_no % 11 = 0 THEN 'hybrid' END",
}


def _simulate(spark, d):
    s = S.sessions(spark, d)
    wishes = s.select("row_no", *[F.expr(e).alias(c) for c, e in OVERRIDE.items()])
    out = O.simulate(s, wishes, ["row_no"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("changed", "resolved_rules", "new_rules")})


_over = ", ".join(f"coalesce({e}, {c}) AS {c}" for c, e in OVERRIDE.items())
_changed = "concat_ws(',', " + ", ".join(f"CASE WHEN ({e}) IS NOT NULL AND ({e}) <> {c} THEN '{c}' END" for c, e in sorted(OVERRIDE.items(), key=lambda kv: O.OVERRIDABLE.index(kv[0]))) + ")"
_resolved = "concat_ws(',', " + ", ".join(f"CASE WHEN f.{r} AND NOT g.{r} THEN '{r.upper()}' END" for r in ALL) + ")"
_new = "concat_ws(',', " + ", ".join(f"CASE WHEN g.{r} AND NOT f.{r} THEN '{r.upper()}' END" for r in ALL) + ")"
add(
    "what_if",
    _simulate,
    f"""WITH {ASSESSED}, oth AS (SELECT * REPLACE ({_over}) FROM sess), {fired_sql('oth', 'fired2')},
b AS (SELECT *, {SCORE} AS sc, {WORST} AS sev FROM fired2), ch AS (SELECT row_no, {_changed} AS changed FROM sess)
SELECT f.row_no, changed, f.risk_score AS risk_score_before, g.sc AS risk_score_after, f.overall_severity AS overall_severity_before, g.sev AS overall_severity_after,
 {_resolved} AS resolved_rules, {_new} AS new_rules FROM assessed f JOIN b g USING (row_no) JOIN ch USING (row_no)""",
)
add(
    "abstain_flags",
    lambda spark, d: S.sessions(spark, d).select(*KEEP, (F.col("traffic.confidence") < 0.6).alias("abstained"), F.when(F.col("traffic.model_version") == "no-esp-observed", "Other").otherwise(F.col("traffic.predicted_type")).alias("predicted_type")),
    f"WITH {SESS} SELECT job_id, row_no, session_id, confidence < 0.6 AS abstained, CASE WHEN model_version = 'no-esp-observed' THEN 'Other' ELSE predicted_type END AS predicted_type FROM sess",
)
