"""Stored results: listing, latest record, job summaries, job diff, and the audit chain."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions import ruletables as R
from culvert.functions.numeric import half_even
from culvert.operators.anomalies import severity_rank
from culvert.plans.skew import one_row, sliced_lag

GENESIS = "0" * 64
CHAIN_SLICE = 65_536


def list_sessions(
    stored: DataFrame, severity: str | None = None, job_id: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Riskiest first, then id; a top-k, never a full sort."""
    df = stored
    if severity:
        df = df.filter(F.col("overall_severity") == severity)
    if job_id:
        df = df.filter(F.col("job_id") == job_id)
    return df.orderBy("risk_score", "session_id", "row_no").offset(offset).limit(limit)


def latest_records(stored: DataFrame, keys: Sequence[str] = ("session_id",), job_id: str | None = None) -> DataFrame:
    """Newest record per key. An ordered aggregate: partial maxima before the shuffle."""
    df = stored.filter(F.col("job_id") == job_id) if job_id else stored
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_us", "row_no")).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def list_events(
    events: DataFrame, session_id: str | None = None, severity: str | None = None, job_id: str | None = None
) -> DataFrame:
    df = events
    for column, value in (("session_id", session_id), ("severity", severity), ("job_id", job_id)):
        if value:
            df = df.filter(F.col(column) == value)
    return df.orderBy(severity_rank(F.col("severity")), F.col("t_us").asc_nulls_first(), "anomaly_id")


def job_summaries(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Severity map, posture and counts per job."""
    counts = [F.count_if(F.col("overall_severity") == s).alias(s) for s in R.SEVERITIES]
    jobs = stored.groupBy("job_id").agg(
        F.max("created_us").alias("created_us"),
        F.count(F.lit(1)).alias("session_count"),
        half_even(F.avg("risk_score")).cast("bigint").alias("posture_score"),
        *counts,
    )
    per_job = events.groupBy("job_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    pairs = [c for s in R.SEVERITIES for c in (F.lit(s), F.col(s))]
    return jobs.join(per_job, "job_id", "left").select(
        "job_id", "created_us", "session_count", "posture_score",
        F.create_map(*pairs).alias("severity_counts"),
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
    )


def list_jobs(summaries: DataFrame, limit: int = 100) -> DataFrame:
    return summaries.orderBy(F.col("created_us").desc(), F.col("job_id").desc()).limit(limit)


def job_exists(stored: DataFrame, job_id: str) -> bool:
    return not stored.filter(F.col("job_id") == job_id).limit(1).isEmpty()


def diff_jobs(stored: DataFrame, base_job: str, compare_job: str) -> DataFrame:
    """Sessions added, removed or scored lower between two jobs, with both records' scores."""
    cols = ["session_id", "risk_score", "overall_severity"]
    base = latest_records(stored.filter(F.col("job_id") == base_job).select(*cols, "created_us", "row_no"))
    comp = latest_records(stored.filter(F.col("job_id") == compare_job).select(*cols, "created_us", "row_no"))
    b = base.select("session_id", F.col("risk_score").alias("base_score"), F.col("overall_severity").alias("base_severity"))
    c = comp.select("session_id", F.col("risk_score").alias("compare_score"), F.col("overall_severity").alias("compare_severity"))
    both = b.join(c, "session_id", "full")
    change = (
        F.when(F.col("base_score").isNull(), "added")
        .when(F.col("compare_score").isNull(), "removed")
        .when(F.col("compare_score") < F.col("base_score"), "degraded")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def documents_digest(documents: DataFrame, keys: Sequence[str], document: Column) -> DataFrame:
    """Order-independent digest of each key's documents, as a tree of SHA-256 sums.

    Equal documents are counted first. Leaves are grouped by 6, then 3, then 0 leading hex digits,
    so one group holds about n / 16 million leaves, then 4096 digests, then 4096 digests, and a
    job with most of the documents still spreads over all tasks.
    """
    keys = list(keys)
    leaves = documents.select(*keys, F.sha2(document, 256).alias("_h")).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_c"))
    level = leaves.withColumn("_e", F.concat_ws("*", "_h", F.col("_c").cast("string")))
    for digits in (6, 3, 0):
        level = (
            level.groupBy(*keys, F.substring("_h", 1, digits).alias("_p"))
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_e")), ","), 256).alias("_d"))
            .select(*keys, F.col("_p").alias("_h"), F.concat_ws("=", "_p", "_d").alias("_e"), "_d")
        )
    return level.select(*keys, F.col("_d").alias("digest"))


def analysis_digest(sessions_digest: DataFrame, events_digest: DataFrame, stats: DataFrame, job: str = "job_id") -> DataFrame:
    """One digest per job over its sessions, its events and its counters (a text column)."""
    e = events_digest.withColumnRenamed("digest", "_e")
    s = sessions_digest.withColumnRenamed("digest", "_s")
    joined = stats.join(s, job, "left").join(e, job, "left")
    return joined.select(
        job, F.sha2(F.concat_ws("|", F.coalesce("_s", F.lit("")), F.coalesce("_e", F.lit("")), F.coalesce("stats", F.lit(""))), 256).alias("analysis_sha256")
    )


LOG_SCHEMA = (
    "seq bigint, job_id string, recorded_at string, analysis_sha256 string, capture_sha256 string, "
    "prev_hash string, entry_hash string"
)


def entry_hash(prev: Column) -> Column:
    return F.sha2(
        F.concat_ws("|", F.col("seq").cast("string"), "job_id", "recorded_at", "analysis_sha256", F.coalesce("capture_sha256", F.lit("")), prev), 256
    )


def new_entries(log: DataFrame, saves: DataFrame) -> DataFrame:
    """Saves whose digest differs from their job's latest entry (or previous save)."""
    last = log.groupBy("job_id").agg(F.max_by("analysis_sha256", "seq").alias("_last"))
    ordered = sliced_lag(saves, ["job_id"], "order_no", {"analysis_sha256": "_prior"}, CHAIN_SLICE)
    joined = ordered.join(last, "job_id", "left")
    before = F.coalesce("_prior", "_last")
    return joined.filter(before.isNull() | (before != F.col("analysis_sha256"))).drop("_prior", "_last")


def append_entries(log: DataFrame, saves: DataFrame) -> DataFrame:
    """Chained entries for a batch of saves (``job_id, order_no, recorded_at`` and two digests).

    Only the new entries are chained, one small row per saved analysis; the log itself is read
    for its head and each job's last digest. A hash chain has no parallel form, so the batch runs
    through one task as a stream of Arrow batches that keeps only the previous hash.
    """
    head = log.agg(F.max("seq").alias("_seq"), F.max_by("entry_hash", "seq").alias("_hash"))
    one = F.lit(1).alias("_one")
    fresh = new_entries(log, saves).select("*", one).join(F.broadcast(head.select("*", one)), "_one")  # head: one row by construction
    fresh = fresh.repartition(1).sortWithinPartitions("order_no")

    named = fresh.withColumnsRenamed({"_seq": "seq0", "_hash": "hash0"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = prev = None
        import hashlib

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if seq is None:
                    seq = 0 if pd.isna(r.seq0) else int(r.seq0)
                    prev = r.hash0 if isinstance(r.hash0, str) else GENESIS
                seq += 1
                capture = r.capture_sha256 if isinstance(r.capture_sha256, str) else None
                text = f"{seq}|{r.job_id}|{r.recorded_at}|{r.analysis_sha256}|{capture or ''}|{prev}"
                digest = hashlib.sha256(text.encode()).hexdigest()
                rows.append((seq, r.job_id, r.recorded_at, r.analysis_sha256, capture, prev, digest))
                prev = digest
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOG_SCHEMA.split(", ")])

    return named.mapInPandas(run, LOG_SCHEMA)


def audit_entries(log: DataFrame, job_id: str | None = None) -> DataFrame:
    df = log.filter(F.col("job_id") == job_id) if job_id else log
    return df.orderBy("seq")


def chain_breaks(log: DataFrame, width: int = CHAIN_SLICE) -> DataFrame:
    """Entries whose link or own hash does not check out; the smallest ``seq`` is the first break.

    Every link is compared with the stored hash before it, which finds the same first break as
    walking the chain, and needs no global order: the previous entry comes from its slice.
    """
    linked = sliced_lag(log, [], "seq", {"entry_hash": "_before"}, width)
    expected = F.coalesce("_before", F.lit(GENESIS))
    bad = (F.col("prev_hash") != expected) | (F.col("entry_hash") != entry_hash(expected))
    return linked.filter(bad).select("seq", "job_id")


def tampered_jobs(log: DataFrame, current: DataFrame) -> DataFrame:
    """Jobs whose newest logged digest differs from the one recomputed; deleted jobs are skipped."""
    latest = log.groupBy("job_id").agg(F.max_by("analysis_sha256", "seq").alias("_logged"))
    joined = latest.join(current.select("job_id", F.col("analysis_sha256").alias("_now")), "job_id")
    return joined.filter(F.col("_logged") != F.col("_now")).select("job_id")


def verify_chain(log: DataFrame, current: DataFrame) -> DataFrame:
    """One row: ok, entries, head hash, first broken seq, tampered job count."""
    head = log.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.max_by("entry_hash", "seq"), F.lit(GENESIS)).alias("head_hash"))
    broken = chain_breaks(log).agg(F.min("seq").alias("chain_broken_at_seq"))
    tampered = tampered_jobs(log, current).agg(F.count(F.lit(1)).alias("tampered"))
    return one_row(head, broken, tampered).withColumn("ok", F.col("chain_broken_at_seq").isNull() & (F.col("tampered") == 0))
