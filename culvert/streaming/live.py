"""Live captures: what changed between two analyses, the change log, and the streaming loop.

Every micro-batch appends its packets, re-analyses the captures it touched, replaces their results
and logs the difference. Late or reordered packets therefore simply change the next result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

TICK = "2 seconds"  # fixed value: pacing of a live run
FINGERPRINT = ("risk_score", "pkt_total", "predicted_type")


def changed_sessions(before: DataFrame, now: DataFrame, key: str = "session_id", watch: Sequence[str] = FINGERPRINT) -> DataFrame:
    """Sessions that are new or whose fingerprint differs from the previous snapshot."""
    old = before.select(key, F.struct(*watch).alias("_old"))
    joined = now.join(old, key, "left")
    return joined.filter(~F.col("_old").eqNullSafe(F.struct(*watch))).drop("_old")


def vanished(before: DataFrame, now: DataFrame, key: str = "session_id") -> DataFrame:
    """Keys the newest analysis no longer has."""
    return before.select(key).distinct().join(now.select(key), key, "left_anti")


def fresh(before: DataFrame, now: DataFrame, key: str = "anomaly_id") -> DataFrame:
    return now.join(before.select(key), key, "left_anti")


def transitions(history: DataFrame, ticks: DataFrame, key: str, watch: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """What each tick changed: ``tick, <key>, removed``, the watched and the carried columns, null where removed.

    ``history`` has one row per (tick, key), ``ticks`` every tick that ran; ticks are consecutive integers, as batch ids are. A
    row is a change if the tick before lacks its key or has other watched values; a key that the next tick lacks is removed there.
    A key meets its own ticks alone, in one shuffle for all ticks.
    """
    by_tick, shown = Window.partitionBy(key).orderBy("tick"), (*watch, *carry)
    seen = history.select(
        "tick", key, *shown,
        F.lag(F.struct("tick", *watch)).over(by_tick).alias("_old"), F.lead("tick").over(by_tick).alias("_next"),
    )
    same = F.col("_old").eqNullSafe(F.struct((F.col("tick") - 1).alias("tick"), *watch))
    gone = F.coalesce(F.col("_next") > F.col("tick") + 1, F.lit(True))
    moves = F.filter(
        F.array(
            F.struct(F.when(~same, F.col("tick")).alias("tick"), F.lit(False).alias("removed"), *shown),
            F.struct(F.when(gone, F.col("tick") + 1).alias("tick"), F.lit(True).alias("removed"), *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in shown]),
        ),
        lambda m: m["tick"].isNotNull(),
    )
    return seen.select(key, F.explode(moves).alias("_m")).select(key, "_m.*").join(ticks.select("tick"), "tick", "left_semi")


def history_feed(
    sessions: DataFrame, events: DataFrame, ticks: DataFrame, session_fields: Sequence[str] = FINGERPRINT, event_fields: Sequence[str] = ("severity",)
) -> DataFrame:
    """The change log of all ticks: ``change_feed`` of every tick against the one before it, from tables of snapshots."""

    def rows(df: DataFrame, kind: str, key: str, fields: Sequence[str]) -> DataFrame:
        name = F.when(F.col("removed"), f"{kind}_removed").otherwise(kind)
        return df.select(name.alias("type"), F.col(key).alias("key"), F.when(~F.col("removed"), F.to_json(F.struct(*fields))).alias("body"), "tick")

    changed = rows(transitions(sessions, ticks, "session_id", session_fields), "session", "session_id", session_fields)
    raised = rows(transitions(events, ticks, "anomaly_id", (), event_fields), "anomaly", "anomaly_id", event_fields)
    alive = ticks.select("tick").join(sessions.groupBy("tick").agg(F.count(F.lit(1)).alias("sessions")), "tick", "left").na.fill(0, ["sessions"])
    status = alive.select(F.lit("live").alias("type"), F.lit("status").alias("key"), F.to_json(F.struct("sessions")).alias("body"), "tick")
    return changed.unionByName(raised).unionByName(status)


def change_feed(
    before: DataFrame, now: DataFrame, events_before: DataFrame, events_now: DataFrame, tick: int | Column,
    session_fields: Sequence[str] = FINGERPRINT, event_fields: Sequence[str] = ("severity",),
) -> DataFrame:
    """Change rows of one tick: retractions, changed sessions, new anomalies, one status row."""

    def rows(df: DataFrame, kind: str, key: str | None, fields: Sequence[str]) -> DataFrame:
        body = F.to_json(F.struct(*fields)) if fields else F.lit(None).cast("string")
        name = F.col(key) if key else F.lit("status")
        return df.select(F.lit(kind).alias("type"), name.alias("key"), body.alias("body"))

    gone = rows(vanished(before, now), "session_removed", "session_id", ())
    stale = rows(vanished(events_before, events_now, "anomaly_id"), "anomaly_removed", "anomaly_id", ())
    changed = rows(changed_sessions(before, now), "session", "session_id", session_fields)
    raised = rows(fresh(events_before, events_now), "anomaly", "anomaly_id", event_fields)
    status = rows(now.agg(F.count(F.lit(1)).alias("sessions")), "live", None, ("sessions",))
    feed = gone.unionByName(stale).unionByName(changed).unionByName(raised).unionByName(status)
    return feed.withColumn("tick", tick if isinstance(tick, Column) else F.lit(tick).cast("bigint"))


def current_state(log: DataFrame) -> DataFrame:
    """Latest state of a change log, newest first; removed keys are dropped."""
    kind = F.regexp_replace("type", "_removed$", "")
    last = log.groupBy(kind.alias("type"), "key").agg(F.max_by(F.struct(F.col("type").alias("t"), "body"), "tick").alias("_l"), F.max("tick").alias("tick"))
    alive = last.filter(~F.col("_l.t").endswith("_removed"))
    return alive.select("type", "key", F.col("_l.body").alias("body"), "tick").orderBy(F.desc("tick"), "type", "key")


class LiveRun:
    """A stream over a growing packet table that keeps per-capture results current.

    ``analyse`` maps all packets of the touched captures to results carrying ``capture``. Packets, touched captures
    and results are tables partitioned by batch below ``root``; a replayed batch overwrites its own partitions, so a
    restart never counts packets twice. A capture's results are those of the last batch that touched it, none if that
    analysis found none. Without ``max_packets`` a run has no end of its own.
    """

    def __init__(self, root: str, analyse: Callable[[DataFrame], DataFrame], capture: str = "capture_id", max_packets: int | None = None):
        self.root, self.analyse, self.capture, self.max_packets = root.rstrip("/"), analyse, capture, max_packets
        self.packets_seen, self.schema = 0, None

    @property
    def packets_path(self) -> str:
        return f"{self.root}/packets"

    @property
    def touched_path(self) -> str:
        return f"{self.root}/touched"

    @property
    def results_path(self) -> str:
        return f"{self.root}/results"

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark, cap = batch.sparkSession, self.capture
        if batch.isEmpty():
            return
        self._write(batch, batch_id, self.packets_path)
        known = spark.read.parquet(self.packets_path)
        self._write(known.filter(F.col("batch") == batch_id).groupBy(cap).agg(F.count("*").alias("packets")), batch_id, self.touched_path)
        touched = spark.read.parquet(self.touched_path)
        self.packets_seen = touched.agg(F.sum("packets")).first()[0]
        results = self.analyse(known.join(touched.filter(F.col("batch") == batch_id), cap, "left_semi").drop("batch"))
        self.schema = results.schema
        self._write(results, batch_id, self.results_path)

    @staticmethod
    def _write(df: DataFrame, batch_id: int, path: str) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TICK)).start()

    def run_until_full(self, query: StreamingQuery, poll: float = 0.5) -> None:
        """Stop the query once the packet cap is reached."""
        while query.isActive:
            if self.max_packets is not None and self.packets_seen >= self.max_packets:
                query.stop()
                return
            time.sleep(poll)

    def results(self, spark: SparkSession) -> DataFrame:
        last = spark.read.parquet(self.touched_path).groupBy(self.capture).agg(F.max("batch").alias("batch"))
        reader = spark.read if self.schema is None else spark.read.schema(StructType([*self.schema.fields, StructField("batch", IntegerType())]))
        return reader.parquet(self.results_path).join(last, [self.capture, "batch"]).drop("batch")


def packet_stream(spark: SparkSession, path: str, schema: StructType, files_per_tick: int | None = None) -> DataFrame:
    """Packet files as a stream; ``path`` may be a folder or a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_tick:
        reader = reader.option("maxFilesPerTrigger", files_per_tick)
    return reader.parquet(path)
