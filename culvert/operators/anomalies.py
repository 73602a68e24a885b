"""Patterns across sessions. Facts are aggregated per group (partial sums before the shuffle) and
handed back to the group's members with the skew-safe ``attach``; every detector that shares a
group shares its facts, so all of them together cost two attachments.

Groups are scoped by ``scope`` (one analysed capture); a session may sit in any number of groups.
Event ids are version-5 UUIDs of kind, session, evidence and description, so analysing the same
capture again yields the same events.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions.ids import uuid5
from culvert.functions.net import is_public
from culvert.functions.ruletables import SEVERITIES
from culvert.plans.skew import attach
from culvert.session import materialise

# Thresholds and name fragments of weak suites.
PROBE_THRESHOLD = 3
BRUTEFORCE_THRESHOLD = 4
STORM_THRESHOLD = 4
STORM_SPAN_US = 60_000_000
WEAK_ENCRYPTION = ("des", "3des", "null")
WEAK_GROUPS = ("modp768", "modp1024", "modp1536", "group 1", "group 2", "group 5")
SCOPE = ("job_id",)
RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "SAFE": 4}


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == "CRITICAL", 0)
    for name, rank in list(RANK.items())[1:]:
        out = out.when(severity == name, rank)
    return out


def observed() -> Column:
    """Cipher and group were both read; an unknown is neither weak nor strong."""
    return (F.col("ike.encryption") != "unknown") & (F.col("ike.dh_group") != "unknown")


def weak_suite() -> Column:
    enc, dh = F.lower(F.coalesce("ike.encryption", F.lit(""))), F.lower(F.coalesce("ike.dh_group", F.lit("")))
    tests = [enc.contains(w) for w in WEAK_ENCRYPTION] + [dh.contains(w) for w in WEAK_GROUPS]
    return reduce(lambda a, b: a | b, tests)


MEMBER_KINDS = ("AGGRESSIVE_MODE_PROBE", "TRANSFORM_BRUTEFORCE", "DOWNGRADE_SUSPECTED", "NAT_T_UNEXPECTED", "REKEY_STORM")
PAIR_KINDS = ("TRANSFORM_BRUTEFORCE", "DOWNGRADE_SUSPECTED", "REKEY_STORM")


def responder_facts(sessions: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Sessions and Aggressive Mode sessions per responder."""
    return sessions.groupBy(*scope, "responder_ip").agg(
        F.count(F.lit(1)).alias("_responder_rows"), F.count_if(_aggressive()).alias("probes")
    )


def pair_facts(sessions: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Everything the pair detectors need, per ordered pair.

    Rows are first counted per (pair, suite); distinct suites are then a count of those rows, so
    no set of suites is ever collected.
    """
    keys = [*scope, "initiator_ip", "responder_ip"]
    suites = sessions.groupBy(*keys, "ike.encryption", "ike.integrity", "ike.dh_group").agg(
        F.count(F.lit(1)).alias("_c"),
        F.bool_or(observed()).alias("_seen"),
        F.bool_or(weak_suite()).alias("_weak"),
        F.count("t_us").alias("_timed"), F.min("t_us").alias("_t0"), F.max("t_us").alias("_t1"),
    )
    return suites.groupBy(*keys).agg(
        F.sum("_c").alias("_pair_rows"),
        F.count_if("_seen").alias("suites"),
        F.bool_or(F.col("_seen") & F.col("_weak")).alias("any_weak"),
        F.bool_or(F.col("_seen") & ~F.col("_weak")).alias("any_strong"),
        F.sum("_timed").alias("timed"),
        (F.max("_t1") - F.min("_t0")).alias("span"),
    )


def _aggressive() -> Column:
    return F.coalesce((F.col("ike.version") == "IKEv1") & F.col("ike.aggressive_mode"), F.lit(False))


def _verdict(kind: str) -> Column:
    """Severity and text of one member detector, NULL where it does not apply."""
    initiator, responder = F.col("initiator_ip"), F.col("responder_ip")

    def count(name: str) -> Column:
        return F.col(name).cast("string")

    if kind == "AGGRESSIVE_MODE_PROBE":
        repeated = F.col("probes") >= PROBE_THRESHOLD
        hit, severity = _aggressive(), F.when(repeated, "CRITICAL").otherwise("HIGH")
        text = F.when(repeated, F.concat(count("probes"), F.lit(" Aggressive Mode exchanges aimed at "), responder)).otherwise(
            F.concat(F.lit("Aggressive Mode exchange exposes a password hash at "), responder)
        )
    elif kind == "TRANSFORM_BRUTEFORCE":
        hit, severity = observed() & (F.col("suites") >= BRUTEFORCE_THRESHOLD), F.lit("HIGH")
        text = F.concat(count("suites"), F.lit(" different suites from "), initiator, F.lit(" to "), responder)
    elif kind == "DOWNGRADE_SUSPECTED":
        hit, severity = observed() & weak_suite() & F.col("any_weak") & F.col("any_strong"), F.lit("HIGH")
        text = F.concat(
            initiator, F.lit(" agreed on "), F.col("ike.encryption"), F.lit(" / "), F.col("ike.dh_group"),
            F.lit(" with "), responder, F.lit(" although both can do better"),
        )
    elif kind == "NAT_T_UNEXPECTED":
        hit, severity = F.col("ike.nat_traversal") & is_public(initiator), F.lit("MEDIUM")
        text = F.concat(F.lit("NAT traversal from public address "), initiator)
    elif kind == "REKEY_STORM":
        hit = F.col("t_us").isNotNull() & (F.col("timed") >= STORM_THRESHOLD) & (F.col("span") <= STORM_SPAN_US)
        severity = F.lit("MEDIUM")
        text = F.concat(
            count("timed"), F.lit(" associations "), initiator, F.lit("->"), responder,
            F.lit(" in "), F.floor(F.col("span") / 1_000_000).cast("string"), F.lit(" s"),
        )
    else:
        raise ValueError(f"unknown detector {kind}")
    return F.when(hit, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), text.alias("text")))


def member_events(sessions: DataFrame, scope: Sequence[str] = SCOPE, kinds: Sequence[str] = MEMBER_KINDS) -> DataFrame:
    """Events raised against individual sessions; each fact table is attached once, whatever ``kinds``."""
    proof = F.col("evidence") if "evidence" in sessions.columns else F.array_join(F.col("packet_refs").cast("array<string>"), ",")
    rows = sessions.select(*scope, "session_id", "t_us", "initiator_ip", "responder_ip", "ike", proof.alias("evidence"))
    if "AGGRESSIVE_MODE_PROBE" in kinds:
        rows = attach(rows, responder_facts(rows, scope), [*scope, "responder_ip"], "_responder_rows")
    if set(kinds) & set(PAIR_KINDS):
        base = sessions.select(*scope, "t_us", "initiator_ip", "responder_ip", "ike")
        rows = attach(rows, pair_facts(base, scope), [*scope, "initiator_ip", "responder_ip"], "_pair_rows")
    hits = F.filter(F.array(*[_verdict(k) for k in kinds]), lambda x: x.isNotNull())
    long = rows.select(*scope, "session_id", "t_us", "evidence", F.explode(hits).alias("e"))
    return long.select(
        uuid5(F.concat_ws("|", "e.kind", "session_id", "evidence", "e.text")).alias("anomaly_id"),
        *scope, "session_id", "t_us", F.col("e.kind").alias("anomaly_type"), F.col("e.severity").alias("severity"),
        F.col("e.text").alias("description"), "evidence",
    )


def spi_collision_evidence(sessions: DataFrame, scope: Sequence[str] = SCOPE, frames: DataFrame | None = None) -> DataFrame:
    """Distinct (session, frame) rows behind collisions, long: no array per session is built.

    ``frames`` holds (scope, session_id, frame) rows where sessions carry no ``packet_refs``.
    """
    refs = frames if frames is not None else sessions.select(*scope, "session_id", F.explode("packet_refs").alias("frame"))
    hit = _collisions(sessions, scope).select(*scope, "session_id")
    return refs.join(hit, [*scope, "session_id"], "left_semi").distinct()


def _collisions(sessions: DataFrame, scope: Sequence[str]) -> DataFrame:
    keys = [*scope, "session_id"]
    pairs = sessions.groupBy(*keys, "initiator_ip", "responder_ip").agg(F.count(F.lit(1)).alias("_c"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs")).filter("pairs > 1")


def spi_collision(sessions: DataFrame, scope: Sequence[str] = SCOPE, frames: DataFrame | None = None) -> DataFrame:
    """One event per session id seen between several ordered pairs.

    The evidence of one event is unbounded, so it enters the id as count, smallest, largest and
    sum of the distinct frames; the frames are rows of ``spi_collision_evidence``.
    """
    keys = [*scope, "session_id"]
    proof = spi_collision_evidence(sessions, scope, frames).groupBy(*keys).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.min("frame"), F.max("frame"), F.sum("frame")).alias("evidence")
    )
    text = F.concat(F.lit("identifier "), F.col("session_id"), F.lit(" used between "), F.col("pairs").cast("string"), F.lit(" peer pairs"))
    m = _collisions(sessions, scope).join(proof, keys, "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return m.select(
        uuid5(F.concat_ws("|", F.lit("SPI_COLLISION"), "session_id", "evidence", text)).alias("anomaly_id"),
        *scope, "session_id", F.lit(None).cast("bigint").alias("t_us"), F.lit("SPI_COLLISION").alias("anomaly_type"),
        F.lit("CRITICAL").alias("severity"), text.alias("description"), "evidence",
    )


def narrow(sessions: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The columns that detectors read."""
    read = F.struct(*(f"ike.{name}" for name in ("version", "aggressive_mode", "encryption", "integrity", "dh_group", "nat_traversal"))).alias("ike")
    given = [c for c in ("evidence", "packet_refs") if c in sessions.columns]
    return sessions.select(*scope, "session_id", "t_us", "initiator_ip", "responder_ip", read, *given)


def detect(sessions: DataFrame, scope: Sequence[str] = SCOPE, frames: DataFrame | None = None) -> DataFrame:
    """All detectors, one event table. What they read of the sessions is written once: facts, members and collisions share it."""
    sessions = materialise(narrow(sessions, scope), "detector-sessions")
    return member_events(sessions, scope).unionByName(spi_collision(sessions, scope, frames))


def fold_by_type(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per kind: worst severity, events, distinct sessions and distinct evidence frames.

    ``evidence`` is long (anomaly_type, frame). Distinct counts go through two aggregations; a
    kind holding most events never sits in one set.
    """
    per_session = events.groupBy("anomaly_type", "session_id").agg(
        F.min(severity_rank(F.col("severity"))).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    base = per_session.groupBy("anomaly_type").agg(
        F.min("_r").alias("_rank"), F.sum("_n").alias("events"), F.count(F.lit(1)).alias("sessions")
    )
    frames = evidence.select("anomaly_type", "frame").distinct().groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    )
    names = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_rank") + 1)
    return (
        base.join(frames, "anomaly_type", "left")
        .select("anomaly_type", names.alias("severity"), "events", "sessions", F.coalesce("frames", F.lit(0)).alias("frames"), "first_frame", "last_frame", "_rank")
        .orderBy("_rank", "anomaly_type").drop("_rank")
    )


def evidence_rows(events: DataFrame, sessions: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """(kind, session, frame) rows of every event; collisions bring their own distinct frames."""
    plain = events.filter("anomaly_type <> 'SPI_COLLISION'").select(
        "anomaly_type", *scope, "session_id", F.explode(F.split("evidence", ",").cast("array<bigint>")).alias("frame")
    )
    hit = spi_collision_evidence(sessions, scope).withColumn("anomaly_type", F.lit("SPI_COLLISION"))
    return plain.unionByName(hit)
