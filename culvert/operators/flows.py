"""Flow features: size, timing, direction and burst statistics of encrypted packets.

A packet table has ``t_us`` (integer microseconds), ``size``, ``src`` and ``frame``. A *flow* is
any set of key columns; the *list* it belongs to (a subset of those keys) decides direction: the
source of the list's first frame is "up".

No flow is ever held by one task. Time is cut into slices, every packet is copied into a
neighbouring slice only when it lies within one burst window of the border, and all burst facts
are local to that margin:

* a packet opens a burst window when the packet ten places later is at most W away;
* a burst starts there unless an earlier opener lies within W;
* a packet is inside a burst when the latest opener at or before it is at most W away;
* it closes the burst when its successor is more than W after that opener.

So counts, sums of starts and sums of ends per slice add up to the flow's burst statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culvert.functions.numeric import half_even, pop_std, pop_var
from culvert.plans.skew import slice_of

FEATURES = (
    "pkt_size_mean", "pkt_size_std", "pkt_size_p10", "pkt_size_p90", "iat_mean_ms", "iat_std_ms", "dir_ratio",
    "burst_count", "burst_gap_ratio", "payload_size_var_burst", "flow_duration_sec", "pkt_total", "rate_pps",
)

BURST_WINDOW_US = 100_000  # fixed values: a burst is more than 10 packets inside 100 ms
BURST_MIN_PACKETS = 10
SLICE_US = 10_000_000


def spi_key(spi: Column) -> Column:
    """Eight hex digits of an SPI, ``unknown`` when it was not readable."""
    return F.coalesce(F.lower(F.lpad(F.hex(spi), 8, "0")), F.lit("unknown"))


def list_leaders(packets: DataFrame, list_keys: Sequence[str]) -> DataFrame:
    """Source address of the first frame of each packet list."""
    return packets.groupBy(*list_keys).agg(F.min_by("src", "frame").alias("up_src"))


def with_margins(packets: DataFrame, keys: Sequence[str], slice_us: int = SLICE_US, window_us: int = BURST_WINDOW_US) -> DataFrame:
    """Each packet in its own slice and, near a border, in the neighbouring one too."""
    own = slice_of(F.col("t_us"), slice_us)
    start = own * slice_us
    homes = F.array(
        own,
        F.when(F.col("t_us") < start + window_us, own - 1),
        F.when(F.col("t_us") >= start + slice_us - window_us, own + 1),
    )
    return (
        packets.select(*keys, "t_us", "size", "frame", own.alias("_own"), F.explode(homes).alias("_slice"))
        .filter(F.col("_slice").isNotNull())
        .withColumn("_core", F.col("_own") == F.col("_slice"))
    )


def packet_positions(
    packets: DataFrame, keys: Sequence[str], window_us: int = BURST_WINDOW_US, min_packets: int = BURST_MIN_PACKETS,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Each packet once, with its gap to the previous packet of the slice and its burst flags."""
    if slice_us < 2 * window_us:
        raise ValueError("a slice must span at least two burst windows")
    return positions(with_margins(packets, keys, slice_us, window_us), keys, window_us, min_packets)


def positions(rows: DataFrame, keys: Sequence[str], window_us: int = BURST_WINDOW_US, min_packets: int = BURST_MIN_PACKETS) -> DataFrame:
    """Positions in whole slices: ``rows`` come from ``with_margins``, all of a slice or none."""
    timed = Window.partitionBy(*keys, "_slice").orderBy("t_us", "frame")
    near = Window.partitionBy(*keys, "_slice").orderBy("t_us")
    t = F.col("t_us")
    rows = (
        rows.withColumn("_prev", F.lag("t_us").over(timed))
        .withColumn("_next", F.lead("t_us").over(timed))
        .withColumn("_opener", F.when(F.lead("t_us", min_packets).over(timed) - t <= window_us, t))
        .withColumn("_before", F.max("_opener").over(timed.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_since", F.max("_opener").over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    inside = F.coalesce(t - F.col("_since") <= window_us, F.lit(False))
    return rows.filter("_core").select(
        *keys, "_slice", "t_us", "size", "frame",
        (t - F.col("_prev")).alias("gap_us"),
        inside.alias("in_burst"),
        (F.col("_opener").isNotNull() & F.coalesce(t - F.col("_before") > window_us, F.lit(True))).alias("burst_start"),
        (inside & F.coalesce(F.col("_next") - F.col("_since") > window_us, F.lit(True))).alias("burst_end"),
    )


def slice_facts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of additive facts per (flow, slice) of packet positions."""
    gap, size, t = F.col("gap_us"), F.col("size"), F.col("t_us")
    return rows.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frame").alias("first_frame"),
        F.sum(size).alias("bytes"),
        F.sum(size * size).alias("bytes2"),
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        F.bool_or(gap.isNull()).alias("_detached"),
        F.coalesce(F.sum(gap * gap), F.lit(0)).alias("_gap2"),
        F.count_if("burst_start").alias("bursts"),
        F.sum(F.when(F.col("burst_start"), t)).alias("starts"),
        F.sum(F.when(F.col("burst_end"), t)).alias("ends"),
        F.min(F.when(F.col("burst_start"), t)).alias("first_start"),
        F.max(F.when(F.col("burst_end"), t)).alias("last_end"),
        F.count_if("in_burst").alias("burst_n"),
        F.sum(F.when(F.col("in_burst"), size)).alias("burst_bytes"),
        F.sum(F.when(F.col("in_burst"), size * size)).alias("burst_bytes2"),
    )


def merge_slices(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts per flow; gaps across slices are added in between."""
    across = Window.partitionBy(*keys).orderBy("_slice")
    jump = (F.col("t_min") - F.lag("t_max").over(across)).cast("decimal(18,0)")
    slices = slices.withColumn("_jump", F.when(F.col("_detached"), jump))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).alias(name)

    return slices.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("first_frame").alias("first_frame"),
        F.sum("bytes").alias("bytes"),
        total("bytes2"),
        F.min("t_min").alias("t_min"),
        F.max("t_max").alias("t_max"),
        F.sum(F.col("_gap2").cast("decimal(38,0)") + F.coalesce(F.col("_jump") * F.col("_jump"), F.lit(0).cast("decimal(38,0)"))).alias("gap2"),
        F.sum("bursts").alias("bursts"),
        F.coalesce(F.sum("starts"), F.lit(0)).alias("starts"),
        F.coalesce(F.sum("ends"), F.lit(0)).alias("ends"),
        F.min("first_start").alias("first_start"),
        F.max("last_end").alias("last_end"),
        F.sum("burst_n").alias("burst_n"),
        F.coalesce(F.sum("burst_bytes"), F.lit(0)).alias("burst_bytes"),
        total("burst_bytes2"),
    )


def _timing(packets: DataFrame, keys: Sequence[str], **burst: int) -> DataFrame:
    return merge_slices(slice_facts(packet_positions(packets, keys, **burst), keys), keys)


def size_percentiles(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p10 and p90 with linear interpolation, over (flow, size) counts: at most 65 536 per flow."""
    return percentiles(size_counts(packets, keys), keys)


def size_counts(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return packets.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("_c"))


def percentiles(sized: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sized.groupBy(*keys).agg(
        F.percentile("size", 0.1, F.col("_c")).alias("p10"), F.percentile("size", 0.9, F.col("_c")).alias("p90")
    )


def direction_bytes(packets: DataFrame, keys: Sequence[str], list_keys: Sequence[str]) -> DataFrame:
    """Bytes up and down per flow, summed per source before the leader is looked up."""
    return split_bytes(source_bytes(packets, keys), list_leaders(packets, list_keys), keys, list_keys)


def source_bytes(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return packets.groupBy(*keys, "src").agg(F.sum("size").alias("_b"))


def split_bytes(by_src: DataFrame, leaders: DataFrame, keys: Sequence[str], list_keys: Sequence[str]) -> DataFrame:
    up = F.col("src").eqNullSafe(F.col("up_src"))
    return (
        by_src.join(leaders, list(list_keys))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(up, F.col("_b"))), F.lit(0)).alias("up_bytes"),
            F.coalesce(F.sum(F.when(~up, F.col("_b"))), F.lit(0)).alias("down_bytes"),
        )
    )


def flow_features(
    packets: DataFrame, keys: Sequence[str], list_keys: Sequence[str] | None = None, **burst: int
) -> DataFrame:
    """The thirteen features per flow, plus ``first_frame``.

    ``keys`` name the flow (one column at least, never NULL); ``list_keys`` default to the first.
    """
    keys = list(keys)
    list_keys = list(list_keys or keys[:1])
    return features_of(_timing(packets, keys, **burst), size_percentiles(packets, keys), direction_bytes(packets, keys, list_keys), keys)


def features_of(timing: DataFrame, sizes: DataFrame, directions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The features of flows from their merged facts."""
    f = timing.join(sizes, list(keys)).join(directions, list(keys))
    n = F.col("n")
    span = (F.col("t_max") - F.col("t_min")).cast("double")
    gaps, bursts = n - 1, F.col("bursts")
    burst_time = (F.col("ends") - F.col("starts")).cast("double")
    idle = F.col("last_end") - F.col("first_start") - (F.col("ends") - F.col("starts"))
    mean_burst = burst_time / bursts.cast("double")
    mean_idle = idle.cast("double") / (bursts - 1).cast("double")
    columns = {
        "pkt_size_mean": F.col("bytes").cast("double") / n.cast("double"),
        "pkt_size_std": pop_std(n, F.col("bytes"), F.col("bytes2")),
        "pkt_size_p10": F.col("p10"),
        "pkt_size_p90": F.col("p90"),
        "iat_mean_ms": F.when(gaps > 0, span / gaps.cast("double") / 1000.0).otherwise(0.0),
        "iat_std_ms": pop_std(gaps, F.col("t_max") - F.col("t_min"), F.col("gap2")) / 1000.0,
        "dir_ratio": F.when(F.col("down_bytes") > 0, F.col("up_bytes").cast("double") / F.col("down_bytes").cast("double"))
        .when(F.col("up_bytes") > 0, n.cast("double"))
        .otherwise(0.0),
        "burst_count": bursts,
        "burst_gap_ratio": F.when(bursts == 0, 0.0)
        .when((bursts > 1) & (idle > 0), mean_burst / mean_idle)
        .otherwise(bursts.cast("double")),
        "payload_size_var_burst": pop_var(F.col("burst_n"), F.col("burst_bytes"), F.col("burst_bytes2")),
        "flow_duration_sec": span / 1000000.0,
        "pkt_total": n,
        "rate_pps": F.when(span > 0, n.cast("double") / (span / 1000000.0)).otherwise(0.0),
    }
    whole = ("burst_count", "pkt_total")
    return f.select(
        *keys, "first_frame", *[(c if k in whole else half_even(c, 4)).alias(k) for k, c in columns.items()]
    )


def capture_vector(packets: DataFrame, capture_key: str = "capture_id") -> DataFrame:
    """One vector over everything a capture holds."""
    return flow_features(packets, [capture_key])


def busiest_flow(flows: DataFrame, list_keys: Sequence[str]) -> DataFrame:
    """The flow with most packets per list; the one seen first wins a tie.

    An ordered aggregate, so the partial maximum is taken before anything is shuffled.
    """
    rest = [c for c in flows.columns if c not in list_keys]
    best = flows.filter("pkt_total > 0").groupBy(*list_keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("pkt_total"), -F.col("first_frame"))).alias("_b")
    )
    return best.select(*list_keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def with_flow(sessions: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every session its flow; without one it gets the zero vector and the no-ESP mark."""
    joined = sessions.join(flows.select(*keys, *FEATURES, F.lit(True).alias("_seen")), list(keys), "left")
    filled = joined.na.fill(0, subset=list(FEATURES))
    return filled.withColumn("has_esp", F.coalesce(F.col("_seen"), F.lit(False))).drop("_seen")


NO_ESP = "no-esp-observed"
