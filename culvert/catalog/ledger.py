"""Stored-result, diff and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.anomalies import EVENTS, stored_events
from culvert.catalog.rules import ASSESSED, SESS, assessed
from culvert.operators import ledger as O
from culvert.plans import standins as S

A = f"WITH {ASSESSED}"
COLS = ["job_id", "row_no", "session_id", "created_us", "risk_score", "overall_severity"]


def stored(s, d):
    return assessed(s, d).select(*COLS)


add(
    "list_sessions",
    lambda s, d: O.list_sessions(stored(s, d), severity="HIGH", job_id="1996", limit=50, offset=10),
    f"{A} SELECT {', '.join(COLS)} FROM assessed WHERE overall_severity = 'HIGH' AND job_id = '1996' ORDER BY risk_score, session_id, row_no LIMIT 50 OFFSET 10",
)
add(
    "latest_sessions",
    lambda s, d: O.latest_records(stored(s, d)),
    f"{A} SELECT {', '.join(COLS)} FROM assessed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_us DESC, row_no DESC) = 1",
)
add(
    "list_events",
    lambda s, d: O.list_events(stored_events(s, d), severity="MEDIUM", job_id="1997"),
    f"WITH {SESS}, {EVENTS} SELECT * FROM ev WHERE severity = 'MEDIUM' AND job_id = '1997'",
)
JOBS = """jb AS (SELECT job_id, max(created_us) AS created_us, count(*) AS session_count, round_even(avg(risk_score), 0)::BIGINT AS posture_score,
 count(*) FILTER (overall_severity = 'CRITICAL') AS critical, count(*) FILTER (overall_severity = 'HIGH') AS high, count(*) FILTER (overall_severity = 'MEDIUM') AS medium,
 count(*) FILTER (overall_severity = 'LOW') AS low, count(*) FILTER (overall_severity = 'SAFE') AS safe FROM assessed GROUP BY job_id),
 je AS (SELECT job_id, count(*) AS anomaly_count FROM ev GROUP BY job_id), js AS (SELECT jb.*, coalesce(anomaly_count, 0) AS anomaly_count FROM jb LEFT JOIN je USING (job_id))"""


def _summaries(s, d):
    out = O.job_summaries(assessed(s, d), stored_events(s, d))
    counts = {k.lower(): F.col("severity_counts")[k] for k in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE")}
    return out.withColumns(counts).drop("severity_counts")


add("job_summaries", _summaries, f"{A}, {EVENTS}, {JOBS} SELECT * FROM js")
add(
    "newest_jobs",
    lambda s, d: O.list_jobs(_summaries(s, d), 3).select("job_id", "created_us", "session_count"),
    f"{A}, {EVENTS}, {JOBS} SELECT job_id, created_us, session_count FROM js ORDER BY created_us DESC, job_id DESC LIMIT 3",
)
add(
    "job_diff",
    lambda s, d: O.diff_jobs(stored(s, d), "1995", "1996"),
    f"""{A}, l AS (SELECT * FROM assessed QUALIFY row_number() OVER (PARTITION BY job_id, session_id ORDER BY created_us DESC, row_no DESC) = 1),
b AS (SELECT session_id, risk_score AS base_score, overall_severity AS base_severity FROM l WHERE job_id = '1995'), c AS (SELECT session_id, risk_score AS compare_score, overall_severity AS compare_severity FROM l WHERE job_id = '1996')
SELECT *, CASE WHEN base_score IS NULL THEN 'added' WHEN compare_score IS NULL THEN 'removed' ELSE 'degraded' END AS change FROM b FULL JOIN c USING (session_id)
WHERE base_score IS NULL OR compare_score IS NULL OR compare_score < base_score""",
)

# Audit: one job per month, so the chain is short and the digest work grows with the table.
MONTH = "job_id || '-' || lpad(cast(cast(row_no % 12 as bigint) as {t}), 2, '0')"
DOC = ["session_id", "row_no", "risk_score", "overall_severity", "triggered_rules"]


def _docs(s, d, tamper: bool):
    df = assessed(s, d).withColumn("job_id", F.expr(MONTH.format(t="string")))
    if tamper:
        df = df.withColumn("risk_score", F.col("risk_score") + F.when(F.col("row_no") % 5000 == 7, 1).otherwise(0))
    doc = F.concat_ws("|", *[F.array_join(c, ",") if c == "triggered_rules" else F.col(c).cast("string") for c in DOC])
    return df.select("job_id", doc.alias("document"))


def digests(s, d, tamper: bool = False):
    docs = _docs(s, d, tamper)
    tree = O.documents_digest(docs, ["job_id"], F.col("document"))
    stats = docs.groupBy("job_id").agg(F.concat(F.lit("sessions="), F.count(F.lit(1)).cast("string")).alias("stats"))
    return O.analysis_digest(tree, tree.limit(0), stats)


def tree_sql(src: str, name: str) -> str:
    out = f"{name}_l AS (SELECT job_id, sha256(doc) AS h, sha256(doc) || '*' || count(*) AS e FROM {src} GROUP BY job_id, doc)"
    prev = f"{name}_l"
    for i, digits in enumerate((6, 3, 0)):
        out += f", {name}_{i} AS (SELECT job_id, substr(h, 1, {digits}) AS p, sha256(string_agg(e, ',' ORDER BY e)) AS d FROM {prev} GROUP BY 1, 2), {name}_{i}e AS (SELECT job_id, p AS h, p || '=' || d AS e FROM {name}_{i})"
        prev = f"{name}_{i}e"
    return out + f", {name}_st AS (SELECT job_id, 'sessions=' || count(*) AS stats FROM {src} GROUP BY 1), {name} AS (SELECT job_id, sha256(d || '||' || stats) AS analysis_sha256 FROM {name}_2 JOIN {name}_st USING (job_id))"


def docs_sql(name: str, bump: str = "0") -> str:
    return f"{name} AS (SELECT {MONTH.format(t='varchar')} AS job_id, concat_ws('|', session_id, row_no, risk_score + {bump}, overall_severity, triggered_rules) AS doc FROM assessed)"


DIG = f"{docs_sql('docs')}, {tree_sql('docs', 'dig')}"
add("analysis_digests", digests, f"{A}, {DIG} SELECT * FROM dig")

LOG_COLS = "seq, job_id, recorded_at, analysis_sha256, capture_sha256, prev_hash, entry_hash"
CHAIN = """sv AS (SELECT *, row_number() OVER (ORDER BY job_id) AS seq, job_id || '-01' AS recorded_at, NULL::VARCHAR AS capture_sha256 FROM dig),
log AS (SELECT seq, job_id, recorded_at, analysis_sha256, capture_sha256, repeat('0', 64) AS prev_hash, sha256(concat(seq, '|', job_id, '|', recorded_at, '|', analysis_sha256, '||', repeat('0', 64))) AS entry_hash FROM sv WHERE seq = 1
 UNION ALL SELECT s.seq, s.job_id, s.recorded_at, s.analysis_sha256, s.capture_sha256, l.entry_hash, sha256(concat(s.seq, '|', s.job_id, '|', s.recorded_at, '|', s.analysis_sha256, '||', l.entry_hash)) FROM log l JOIN sv s ON s.seq = l.seq + 1)"""
AR = f"WITH RECURSIVE {ASSESSED}"


def audit_log(s, d):
    saves = digests(s, d).select(
        "job_id", F.expr("cast(replace(job_id, '-', '') as bigint)").alias("order_no"), F.concat("job_id", F.lit("-01")).alias("recorded_at"),
        "analysis_sha256", F.lit(None).cast("string").alias("capture_sha256"),
    )
    return O.append_entries(s.createDataFrame([], O.LOG_SCHEMA), saves)


def tampered_log(s, d):
    """The log with the 40th entry's digest altered after the fact."""
    return audit_log(s, d).withColumn("analysis_sha256", F.when(F.col("seq") == 40, F.sha2("analysis_sha256", 256)).otherwise(F.col("analysis_sha256")))


add("audit_log", lambda s, d: O.audit_entries(audit_log(s, d)), f"{AR}, {DIG}, {CHAIN} SELECT {LOG_COLS} FROM log")
BREAKS = """bad AS (SELECT seq, job_id FROM (SELECT *, coalesce(lag(entry_hash) OVER (ORDER BY seq), repeat('0', 64)) AS ph FROM tl)
 WHERE prev_hash <> ph OR entry_hash <> sha256(concat(seq, '|', job_id, '|', recorded_at, '|', analysis_sha256, '||', ph)))"""
TL = "tl AS (SELECT * REPLACE (CASE WHEN seq = 40 THEN sha256(analysis_sha256) ELSE analysis_sha256 END AS analysis_sha256) FROM log)"
add("audit_chain_breaks", lambda s, d: O.chain_breaks(tampered_log(s, d)), f"{AR}, {DIG}, {CHAIN}, {TL}, {BREAKS} SELECT * FROM bad")
DIG2 = f"{docs_sql('docs2', '(CASE WHEN row_no % 5000 = 7 THEN 1 ELSE 0 END)')}, {tree_sql('docs2', 'dig2')}"
add(
    "audit_verify",
    lambda s, d: O.verify_chain(audit_log(s, d), digests(s, d, tamper=True)),
    f"""{AR}, {DIG}, {DIG2}, {CHAIN}, tl AS (SELECT * FROM log), {BREAKS}
SELECT (SELECT count(*) FROM log) AS entries, (SELECT arg_max(entry_hash, seq) FROM log) AS head_hash, (SELECT min(seq) FROM bad) AS chain_broken_at_seq,
 (SELECT count(*) FROM dig JOIN dig2 USING (job_id) WHERE dig.analysis_sha256 <> dig2.analysis_sha256) AS tampered,
 (SELECT count(*) FROM bad) = 0 AND (SELECT count(*) FROM dig JOIN dig2 USING (job_id) WHERE dig.analysis_sha256 <> dig2.analysis_sha256) = 0 AS ok""",
)
