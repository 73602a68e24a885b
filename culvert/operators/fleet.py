"""Rollups over assessed sessions and their long tables (findings, threats, compliance, exposure).

Inputs are the outputs of ``operators.rules``. Every rollup is a partial + final aggregate; the
only joins are with tables whose size is fixed by the rule set or by ``limit``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culvert.functions import ruletables as R
from culvert.functions.net import ipv4_to_long
from culvert.functions.numeric import half_even
from culvert.operators.anomalies import severity_rank
from culvert.operators.flows import NO_ESP
from culvert.session import materialise

TRAFFIC_ORDER = ("VoIP", "Video", "Web", "Email", "ICMP", "Chat", "Other")  # fixed display order
LEVELS = ("High", "Med", "Low")


def level_rank(level: Column) -> Column:
    return F.when(level == "High", 0).when(level == "Med", 1).otherwise(2)


def _mean_or(value: Column, empty: int) -> Column:
    return F.coalesce(half_even(F.avg(value)), F.lit(float(empty))).cast("bigint")


def posture(assessed: DataFrame) -> DataFrame:
    return assessed.agg(_mean_or(F.col("risk_score"), 100).alias("posture_score"))


def severity_counts(assessed: DataFrame) -> DataFrame:
    """All five severities in order, zeros included, from a single pass."""
    counts = assessed.agg(*[F.count_if(F.col("overall_severity") == s).alias(s) for s in R.SEVERITIES])
    cells = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"), F.col(s).alias("sessions")) for i, s in enumerate(R.SEVERITIES)])
    return counts.select(F.explode(cells).alias("c")).select("c.rank", "c.severity", "c.sessions")


def top_findings(findings: DataFrame, limit: int = 3) -> DataFrame:
    """Most severe, then most frequent rules; the rule id breaks ties."""
    per_rule = findings.groupBy("rule_id", "severity", "description").agg(F.count(F.lit(1)).alias("session_count"))
    return per_rule.orderBy(severity_rank(F.col("severity")), F.col("session_count").desc(), "rule_id").limit(limit)


def top_finding_sessions(findings: DataFrame, limit: int = 3) -> DataFrame:
    """Sessions behind the top findings, one row each; the broadcast side has ``limit`` rows."""
    top = F.broadcast(top_findings(findings, limit).select("rule_id"))
    return findings.join(top, "rule_id", "left_semi")


def classified(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("traffic.model_version") != NO_ESP)


def traffic_mix(sessions: DataFrame) -> DataFrame:
    """Sessions per predicted type, in the fixed display order."""
    order = reduce(lambda c, kv: c.when(F.col("predicted_type") == kv[1], kv[0]), enumerate(TRAFFIC_ORDER), F.when(F.lit(False), -1))
    mix = classified(sessions).groupBy(F.col("traffic.predicted_type").alias("predicted_type")).agg(F.count(F.lit(1)).alias("sessions"))
    return mix.withColumn("position", order.otherwise(len(TRAFFIC_ORDER))).orderBy("position", "predicted_type")


def confidence_stats(sessions: DataFrame) -> DataFrame:
    """Classified and abstained counts and the mean confidence to three decimals.

    Confidences carry four decimals, so they are summed as integers: no order dependence.
    """
    ten_k = half_even(F.col("traffic.confidence") * 10000.0).cast("bigint")
    return classified(sessions).agg(
        F.count(F.lit(1)).alias("classified_count"),
        F.count_if("traffic.abstained").alias("abstained_count"),
        half_even(F.sum(ten_k).cast("double") / F.count(F.lit(1)).cast("double") / 10000.0, 3).alias("mean_ai_confidence"),
    )


def threat_matrix(threats: DataFrame) -> DataFrame:
    return (
        threats.select("threat", "likelihood", "impact").distinct()
        .orderBy(level_rank(F.col("impact")), level_rank(F.col("likelihood")), "threat")
    )


def threat_grid(threats: DataFrame) -> DataFrame:
    """All nine likelihood x impact cells with counts, distinct threats and an intensity step.

    One pass: the grid is nine conditional aggregates over rows counted per (cell, threat).
    """
    per_threat = threats.groupBy("likelihood", "impact", "threat").agg(F.count(F.lit(1)).alias("_c"))
    aggs, cells = [], []
    for impact in LEVELS:
        for likelihood in reversed(LEVELS):
            hit = (F.col("impact") == impact) & (F.col("likelihood") == likelihood)
            n, d = f"n_{likelihood}_{impact}", f"d_{likelihood}_{impact}"
            aggs += [F.coalesce(F.sum(F.when(hit, F.col("_c"))), F.lit(0)).alias(n), F.count_if(hit).alias(d)]
            cells.append(F.struct(F.lit(likelihood).alias("likelihood"), F.lit(impact).alias("impact"), F.col(n).alias("count"), F.col(d).alias("threats")))
    grid = per_threat.agg(*aggs).select(F.greatest(*[c["count"] for c in cells]).alias("_max"), F.explode(F.array(*cells)).alias("c"))
    return grid.select("c.*", ramp_step(F.col("c.count"), F.col("_max")).alias("step"))


def ramp_step(count: Column, busiest: Column) -> Column:
    """0 for nothing, else 1 (over 80 % of the busiest cell) to 5."""
    share = count.cast("double") / busiest.cast("double")
    return (
        F.when(count == 0, 0).when(share > 0.8, 1).when(share > 0.6, 2).when(share > 0.4, 3).when(share > 0.2, 4).otherwise(5)
    )


def fleet_exposure(exposed: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("exposure_level") == v).alias(f"level_{v.lower()}") for v in LEVELS]
    return exposed.agg(_mean_or(F.col("exposure_score"), 0).alias("mean_score"), *levels)


def leaking_signals(exposed: DataFrame) -> DataFrame:
    """Sessions per signal at level High or Med, most frequent first."""
    sig = exposed.select(F.explode("exposure_signals").alias("s")).select("s.signal", "s.level")
    counts = sig.filter(F.col("level").isin("High", "Med")).groupBy("signal").agg(F.count(F.lit(1)).alias("sessions"))
    return counts.orderBy(F.col("sessions").desc(), "signal")


def compliance_rollup(compliance: DataFrame) -> DataFrame:
    """Sessions per status and baseline."""
    return compliance.groupBy("baseline_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "not_assessed")]
    )


def common_violations(compliance: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent violations per baseline."""
    v = compliance.select("baseline_id", F.explode("violations").alias("violation"))
    counts = v.groupBy("baseline_id", "violation").agg(F.count(F.lit(1)).alias("sessions"))
    order = Window.partitionBy("baseline_id").orderBy(F.col("sessions").desc(), "violation")
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def pqc_readiness(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.col("ike.pqc_status").alias("pqc_status")).agg(F.count(F.lit(1)).alias("sessions"))


def summary(assessed: DataFrame) -> DataFrame:
    """One row of headline numbers, one pass; ``assessed`` also carries the exposure columns."""
    seen = F.col("traffic.model_version") != NO_ESP
    ten_k = half_even(F.col("traffic.confidence") * 10000.0).cast("bigint")
    return assessed.agg(
        F.count(F.lit(1)).alias("session_count"),
        _mean_or(F.col("risk_score"), 100).alias("posture_score"),
        *[F.count_if(F.col("overall_severity") == s).alias(s.lower()) for s in R.SEVERITIES],
        _mean_or(F.col("exposure_score"), 0).alias("mean_exposure"),
        *[F.count_if(F.col("ike.pqc_status") == s).alias(f"pqc_{s}") for s in ("hybrid", "classical", "unknown")],
        F.count_if(seen).alias("classified_count"),
        F.count_if(seen & F.col("traffic.abstained")).alias("abstained_count"),
        F.when(F.count_if(seen) > 0, half_even(F.sum(F.when(seen, ten_k)).cast("double") / F.count_if(seen).cast("double") / 10000.0, 3)).alias("mean_ai_confidence"),
    )


def with_verdict(summary_row: DataFrame) -> DataFrame:
    """Overall severity and one sentence for a summary row."""
    overall = F.lit("SAFE")
    for s in reversed(R.SEVERITIES[:-1]):
        overall = F.when(F.col(s.lower()) > 0, F.lit(s)).otherwise(overall)
    total = F.col("session_count").cast("string")
    worst = F.when(F.col("critical") > 0, F.col("critical")).otherwise(F.col("high")).cast("string")
    label = F.when(F.col("critical") > 0, "critical").otherwise("high-severity")
    text = (
        F.when(F.col("session_count") == 0, F.lit("The capture holds no tunnels."))
        .when(overall == "SAFE", F.concat(F.lit("All "), total, F.lit(" tunnels meet the baseline.")))
        .otherwise(F.concat(worst, F.lit(" of "), total, F.lit(" tunnels have "), label, F.lit(" weaknesses.")))
    )
    return summary_row.select("session_count", overall.alias("overall_severity"), text.alias("verdict"))


def actions(findings: DataFrame, limit: int = 3) -> DataFrame:
    """What to do about each top finding."""
    top = top_findings(findings, limit)
    many = F.when(F.col("session_count") == 1, "tunnel").otherwise("tunnels")
    return top.select(
        "rule_id",
        F.concat("description", F.lit(": change the configuration of "), F.col("session_count").cast("string"), F.lit(" "), many, F.lit(".")).alias("action"),
    )


def finding_links(findings: DataFrame) -> DataFrame:
    """Reference pages per rule seen."""
    page = F.lit(None).cast("string")
    for key, url in reversed(R.STANDARD_PAGES):
        page = F.when(F.col("standard").contains(key), F.lit(url)).otherwise(page)
    cve = F.when(F.col("cve").isNotNull(), F.concat(F.lit(R.CVE_PAGE), F.col("cve")))
    return findings.select("rule_id", "standard", "cve").distinct().withColumns({"cve_url": cve, "standard_url": page})


def gloss(column: Column, table: dict[str, str]) -> Column:
    """Plain-language text for a code, as one CASE."""
    items = list(table.items())
    out = F.when(column == items[0][0], F.lit(items[0][1]))
    for key, text in items[1:]:
        out = out.when(column == key, F.lit(text))
    return out


def rank_events(events: DataFrame) -> DataFrame:
    return events.orderBy(severity_rank(F.col("severity")), "anomaly_type", F.col("t_us").asc_nulls_first(), "anomaly_id")


def event_kinds(events: DataFrame) -> DataFrame:
    """Kinds by their worst severity, with a gloss."""
    kinds = events.groupBy("anomaly_type").agg(F.min(severity_rank(F.col("severity"))).cast("int").alias("rank"), F.count(F.lit(1)).alias("events"))
    return kinds.withColumn("meaning", gloss(F.col("anomaly_type"), R.ANOMALY_GLOSS)).orderBy("rank", "anomaly_type")


def risk_histogram(assessed: DataFrame) -> DataFrame:
    """Ten bins of ten points, empty ones included; 100 falls into the last."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("risk_score")))
    bin_no = F.least(F.lit(9), F.floor(score / 10)).cast("int")
    counts = assessed.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    wide = counts.agg(*[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("_c"))), F.lit(0)).alias(f"b{i}") for i in range(10)])
    cells = [F.struct(F.lit(i).alias("bin"), F.lit(f"{i * 10}-{i * 10 + 9}").alias("band"), F.col(f"b{i}").alias("sessions")) for i in range(10)]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _addressed(assessed: DataFrame) -> DataFrame:
    return assessed.filter((F.coalesce("initiator_ip", F.lit("")) != "") & (F.coalesce("responder_ip", F.lit("")) != ""))


def peer_nodes(assessed: DataFrame) -> DataFrame:
    """Worst severity and session count per address; a tunnel to itself counts twice."""
    ends = _addressed(assessed).select(F.explode(F.array("initiator_ip", "responder_ip")).alias("peer"), "overall_severity")
    nodes = ends.groupBy("peer").agg(F.min(severity_rank(F.col("overall_severity"))).alias("_r"), F.count(F.lit(1)).alias("sessions"))
    name = F.element_at(F.array(*[F.lit(s) for s in R.SEVERITIES]), F.col("_r") + 1)
    return nodes.select("peer", name.alias("severity"), "sessions")


def peer_edges(assessed: DataFrame) -> DataFrame:
    return _addressed(assessed).select(
        F.col("initiator_ip").alias("source"), F.col("responder_ip").alias("target"), "session_id", F.col("overall_severity").alias("severity")
    )


def distinct_peers(sessions: DataFrame) -> DataFrame:
    ends = sessions.select(F.explode(F.array("initiator_ip", "responder_ip")).alias("peer"))
    return ends.filter(F.coalesce("peer", F.lit("")) != "").distinct()


SORTS = {
    "risk": lambda: [severity_rank(F.col("overall_severity")), F.col("risk_score")],
    "cipher": lambda: [F.col("ike.encryption")],
    "peer": lambda: [ipv4_to_long(F.col("initiator_ip")), F.col("initiator_ip")],
    "version": lambda: [F.col("ike.version")],
}


def sort_order(key: str, descending: bool = False, tie: str = "row_no") -> list[Column]:
    return [c.desc() if descending else c.asc() for c in SORTS[key]() + [F.col(tie)]]


def sort_sessions(assessed: DataFrame, key: str, descending: bool = False, tie: str = "row_no") -> DataFrame:
    return assessed.orderBy(*sort_order(key, descending, tie))


def filter_sessions(
    assessed: DataFrame, version: str | None = None, severity: str | None = None, peer: str | None = None, search: str | None = None
) -> DataFrame:
    df = assessed
    peers = F.concat_ws(" ", "initiator_ip", "responder_ip")
    if version:
        df = df.filter(F.col("ike.version") == version)
    if severity:
        df = df.filter(F.col("overall_severity") == severity)
    if peer:
        df = df.filter(peers.contains(peer))
    needle = (search or "").strip().lower()
    if needle:
        df = df.filter(search_text().contains(needle))
    return df


def page(ordered: DataFrame, index: int, size: int) -> DataFrame:
    return ordered.offset(index * size).limit(size)


class PageIndex:
    """A listing in one full order, written once with the place of every row, so that any page is a look-up by place.

    Rows are range-partitioned by the sort columns (the last of them unique, so that equal keys split too) and sorted
    within ranges; a row's place is its place in its range plus the sizes of earlier ranges. The index is written in
    order, so that a page reads the few row groups that hold its places, however deep it lies.
    """

    def __init__(self, df: DataFrame, order: list[Column], partitions: int | None = None):
        spark = df.sparkSession
        self.columns = df.columns
        ranged = df.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        cut = materialise(ranged.withColumn("_range", F.spark_partition_id()), "page-ranges")
        sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
        placed = cut.withColumn("_own", own).join(F.broadcast(before.select("_range", "_before")), "_range")  # one row for each range
        self.table = materialise(placed.select((F.col("_before") + F.col("_own") - 1).alias("place"), *self.columns), "page-index")

    def page(self, index: int, size: int) -> DataFrame:
        """Rows ``index * size`` and on of the full order, with their ``place``; none beyond the end."""
        first = index * size
        return self.table.filter((F.col("place") >= first) & (F.col("place") < first + size))

    def pages(self, size: int) -> DataFrame:
        """The number of the page of every row, beside the row."""
        return self.table.withColumn("page", F.floor(F.col("place") / size).cast("long"))


SEARCHED = ("session_id", "initiator_ip", "responder_ip", "ike.encryption", "ike.dh_group", "ike.vendor", "traffic.predicted_type")


def search_text() -> Column:
    """What a search looks at: the fields in lower case, a null one left out, with single spaces between them."""
    return F.lower(F.concat_ws(" ", *SEARCHED))


GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of up to three characters of a text, the empty one included."""
    starts = F.sequence(F.lit(1), F.length(text) + 1)
    return F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, range(GRAM + 1))), lambda n: F.transform(starts, lambda i: F.substr(text, i, n)))))


class SearchIndex:
    """Postings of character runs over the searched fields, for many needles at a time.

    ``texts`` holds each distinct text once, ``members`` its rows, ``postings`` (gram, text_id) its runs of up to three
    characters; these and the number of texts of each gram are written once. A needle meets the postings of its rarest run of
    three alone (a shorter needle is a run itself), and each text found is verified, so answers are those of a scan.
    """

    def __init__(self, rows: DataFrame, id_col: str):
        texts = rows.select(F.col(id_col).alias("row_id"), search_text().alias("text"))
        # numbered and then stored, so that a text keeps its number; a digest would be most of each posting
        self.texts = materialise(texts.select("text").distinct().withColumn("text_id", F.monotonically_increasing_id()), "search-texts")
        self.members = materialise(texts.join(self.texts, "text").select("text_id", "row_id"), "search-rows")
        found = self.texts.select("text_id", F.explode(grams(F.col("text"))).alias("gram"))
        self.postings = materialise(found.repartitionByRange("gram", "text_id").sortWithinPartitions("gram", "text_id"), "search-postings")
        self.sizes = materialise(self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "search-grams")

    def find(self, needles: DataFrame, column: str = "needle") -> DataFrame:
        """``needle, row_id`` of every row whose text contains the needle, trimmed and in lower case; an empty or null needle finds every row."""
        asked = needles.select(F.col(column).alias("needle"), F.lower(F.trim(F.coalesce(column, F.lit("")))).alias("sought")).distinct()
        own = F.filter(grams(F.col("sought")), lambda g: F.length(g) == F.least(F.length("sought"), F.lit(GRAM)))
        counted = asked.select("needle", "sought", F.explode(own).alias("gram")).join(self.sizes, "gram", "left")
        # a run that no text has counts as the rarest: nothing is found
        rarest = counted.groupBy("needle", "sought").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
        met = rarest.join(self.postings, "gram").join(self.texts, "text_id").filter(F.contains("text", "sought"))
        return met.select("needle", "text_id").join(self.members, "text_id").select("needle", "row_id")


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("bigint").alias("pages"))


def worst_severity(assessed: DataFrame) -> DataFrame:
    """Worst severity (SAFE when there are no rows) and the non-zero tally as text."""
    rank = F.coalesce(F.min(severity_rank(F.col("overall_severity"))), F.lit(4))
    counts = [F.count_if(F.col("overall_severity") == s).alias(f"_{s}") for s in R.SEVERITIES]
    row = assessed.agg(rank.alias("_r"), *counts)
    parts = [F.when(F.col(f"_{s}") > 0, F.concat(F.lit(f"{s}="), F.col(f"_{s}").cast("string"))) for s in R.SEVERITIES]
    return row.select(F.element_at(F.array(*[F.lit(s) for s in R.SEVERITIES]), F.col("_r") + 1).alias("worst"), F.concat_ws(",", *parts).alias("tally"))
