"""Change-feed queries over two snapshots, and a stream that must agree with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.anomalies import EVENTS, stored_events
from culvert.catalog.flows import BASE, ESP, flow_cte
from culvert.catalog.rules import ASSESSED, assessed
from culvert.operators import flows as FL
from culvert.operators import ledger as L
from culvert.plans import standins as S
from culvert.session import materialise, shared_dir
from culvert.streaming import live as O
from culvert.streaming.incremental import LiveFlows

A = f"WITH {ASSESSED}"


def snapshots(s, d):
    """Each job's latest record per session: one snapshot per tick of a live run, stored as a run stores them."""
    df = assessed(s, d).withColumn("tick", F.col("job_id").cast("bigint"))
    flat = df.select("tick", "session_id", "created_us", "row_no", "risk_score", F.col("flow.pkt_total").alias("pkt_total"), F.col("traffic.predicted_type").alias("predicted_type"))
    return materialise(L.latest_records(flat, ("tick", "session_id")).select("tick", "session_id", *O.FINGERPRINT), "snapshots")


def event_snapshots(s, d):
    """Each job's events, one row per event id."""
    return stored_events(s, d).withColumn("tick", F.col("job_id").cast("bigint")).groupBy("tick", "anomaly_id").agg(F.min("severity").alias("severity"))


def _ticks(df):
    return df.select("tick").distinct()


SNAPS = """t AS (SELECT job_id::BIGINT AS tick, session_id, risk_score, pkt_total, predicted_type FROM assessed QUALIFY row_number() OVER (PARTITION BY job_id, session_id ORDER BY created_us DESC, row_no DESC) = 1),
ch AS (SELECT t.* FROM t LEFT JOIN t p ON p.tick = t.tick - 1 AND p.session_id = t.session_id
 WHERE p.session_id IS NULL OR p.risk_score IS DISTINCT FROM t.risk_score OR p.pkt_total IS DISTINCT FROM t.pkt_total OR p.predicted_type IS DISTINCT FROM t.predicted_type),
va AS (SELECT t.tick + 1 AS tick, t.session_id FROM t LEFT JOIN t n ON n.tick = t.tick + 1 AND n.session_id = t.session_id WHERE n.session_id IS NULL AND t.tick + 1 IN (SELECT tick FROM t))"""


def _sessions(s, d):
    h = snapshots(s, d)
    return O.transitions(h, _ticks(h), "session_id", O.FINGERPRINT)


add("live_changed_sessions", lambda s, d: _sessions(s, d).filter("not removed").drop("removed"), f"{A}, {SNAPS} SELECT * FROM ch")
add("live_vanished_sessions", lambda s, d: _sessions(s, d).filter("removed").select("tick", "session_id"), f"{A}, {SNAPS} SELECT * FROM va")

EVT = f"""{EVENTS}, v AS (SELECT job_id::BIGINT AS tick, anomaly_id, min(severity) AS severity FROM ev GROUP BY ALL),
en AS (SELECT v.* FROM v LEFT JOIN v p ON p.tick = v.tick - 1 AND p.anomaly_id = v.anomaly_id WHERE p.anomaly_id IS NULL),
es AS (SELECT v.tick + 1 AS tick, v.anomaly_id FROM v LEFT JOIN v n ON n.tick = v.tick + 1 AND n.anomaly_id = v.anomaly_id WHERE n.anomaly_id IS NULL AND v.tick + 1 IN (SELECT job_id::BIGINT FROM sess))"""


def _events(s, d):
    ticks = S.sessions(s, d).select(F.col("job_id").cast("bigint").alias("tick")).distinct()
    return O.transitions(event_snapshots(s, d), ticks, "anomaly_id", (), ("severity",))


add("live_new_events", lambda s, d: _events(s, d).filter("not removed").drop("removed"), f"{A}, {EVT} SELECT * FROM en")
add("live_superseded_events", lambda s, d: _events(s, d).filter("removed").select("tick", "anomaly_id"), f"{A}, {EVT} SELECT * FROM es")
FEED_SQL = """fd AS (SELECT 'session' AS type, session_id AS key, tick FROM ch UNION ALL SELECT 'session_removed', session_id, tick FROM va
 UNION ALL SELECT 'anomaly', anomaly_id, tick FROM en UNION ALL SELECT 'anomaly_removed', anomaly_id, tick FROM es UNION ALL SELECT DISTINCT 'live', 'status', tick FROM t)"""


def feed(s, d):
    h = snapshots(s, d)
    return O.history_feed(h, materialise(event_snapshots(s, d), "event-snapshots"), _ticks(h))


add("live_change_feed", lambda s, d: feed(s, d).select("type", "key", "tick"), f"{A}, {SNAPS}, {EVT}, {FEED_SQL} SELECT type, key, tick FROM fd")
add(
    "live_current_state",
    lambda s, d: O.current_state(feed(s, d)).select("type", "key", "tick"),
    f"""{A}, {SNAPS}, {EVT}, {FEED_SQL}, l AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY replace(type, '_removed', ''), key ORDER BY tick DESC) = 1)
SELECT type, key, tick FROM l WHERE type NOT LIKE '%\\_removed' ESCAPE '\\'""",
)


FILES = 6


def _stream(s, d):
    """Flows kept current by a stream over files of successive times, each batch reading its own slices."""
    base = f"{shared_dir(s, 'live')}-{uuid.uuid4().hex}"
    esp = S.esp_packets(s, d)
    esp.repartitionByRange(FILES, "t_us").write.parquet(f"{base}/in")
    run = LiveFlows(f"{base}/run", ["capture_id"], epoch=4)
    stream = O.packet_stream(s, f"{base}/in", esp.schema, files_per_tick=1)
    run.start(stream, f"{base}/checkpoint", available_now=True).awaitTermination()
    return run.results(s)


add("live_capture_vectors", _stream, f"WITH {ESP}, {BASE}, {flow_cte(['capture_id'], ['capture_id'])} SELECT * FROM feat")
