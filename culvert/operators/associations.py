"""Security associations: grouping messages, finding each packet's owner, mid-session records.

Messages carry ``capture_id``, ``init_spi``, ``frame`` and the header columns. Everything per
association is an ordered aggregate on ``frame`` (``min_by``/``max_by``), which Spark combines
before the shuffle, so an association holding most of the messages costs one small row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions.net import peer_pair
from culvert.plans.skew import attach

SA = ["capture_id", "init_spi"]
ZERO_SPI = "0" * 16
FRAGMENT_TYPES = (53, 132)  # fixed values: fragment payload numbers
OPENING_EXCHANGES = (34, 2, 4)
ANTI_REPLAY_MIN = 4
MID_SESSION_REFS = 20


def has_payload(*types: int) -> Column:
    return F.exists("payload_types", lambda p: p.isin(*types))


def group_messages(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """One row per association: version, peers, session id, flags and counters.

    Passing ``[*SA, "peers"]`` as keys (with a ``peers`` column) keeps one initiator SPI seen
    between two peer pairs as two associations.
    """
    frame = F.col("frame")
    opener = ~F.col("is_response") & (F.col("message_id") == 0)
    ends = F.struct("src", "dst")
    grouped = messages.groupBy(*keys).agg(
        F.min_by("version", "frame").alias("version"),
        F.min_by(F.when(F.col("src").contains(":"), "IPv6").otherwise("IPv4"), frame).alias("ip_version"),
        F.coalesce(F.min_by(ends, F.when(opener, frame)), F.min_by(ends, frame)).alias("_ends"),
        F.min_by("resp_spi", F.when(F.col("resp_spi") != ZERO_SPI, frame)).alias("_resp"),
        F.bool_or(F.col("udp_port") == 4500).alias("nat_traversal"),
        F.bool_or(has_payload(*FRAGMENT_TYPES)).alias("fragmented"),
        F.bool_or((F.col("message_id") == 0) & F.col("exchange").isin(*OPENING_EXCHANGES)).alias("complete"),
        F.count(F.lit(1)).alias("ike_packets"),
        F.min(F.when(F.col("t_us") != 0, F.col("t_us"))).alias("first_t_us"),
    )
    return grouped.select(
        *keys,
        F.concat_ws("-", F.col("init_spi"), F.coalesce("_resp", F.lit(ZERO_SPI))).alias("session_id"),
        "version", "ip_version",
        F.col("_ends.src").alias("initiator_ip"), F.col("_ends.dst").alias("responder_ip"),
        "nat_traversal", "fragmented", "complete", "ike_packets", "first_t_us",
    )


def evidence_frames(messages: DataFrame) -> DataFrame:
    """Frames and lengths of each association, one row per message in ``frame`` order.

    Kept long on purpose: an array per association would gather an unbounded group.
    """
    return messages.select(*SA, "frame", F.coalesce("length", F.lit(0)).alias("length"))


def sa_pairs(associations: DataFrame) -> DataFrame:
    """Distinct unordered peer pairs that set up at least one association, with their count."""
    pair = peer_pair(F.col("initiator_ip"), F.col("responder_ip"))
    return associations.groupBy("capture_id", pair.alias("owner")).agg(
        F.min(F.least("initiator_ip", "responder_ip")).alias("low"),
        F.min(F.greatest("initiator_ip", "responder_ip")).alias("high"),
        F.count(F.lit(1)).alias("sa_count"),
    )


def packet_pairs(packets: DataFrame) -> DataFrame:
    """Distinct unordered peer pairs of data packets, with their packet count."""
    return packets.groupBy("capture_id", peer_pair(F.col("src"), F.col("dst")).alias("peers")).agg(
        F.min(F.least("src", "dst")).alias("low"), F.min(F.greatest("src", "dst")).alias("high"),
        F.count(F.lit(1)).alias("pair_packets"),
    )


def pair_owners(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner pair of every packet pair: the same pair, else the only pair sharing an address.

    A pair with no exact owner shares at most one address with any owner pair, so its number of
    candidates is the sum of two per-address counts. No overlap join and no list of candidates
    is built, however many tunnels one gateway address terminates.
    """
    exact = pairs.join(owners.select("capture_id", F.col("owner").alias("peers"), F.lit("exact").alias("how")), ["capture_id", "peers"], "left")
    by_address = (
        owners.select("capture_id", "owner", F.explode(F.array_distinct(F.array("low", "high"))).alias("address"))
        .groupBy("capture_id", "address")
        .agg(F.count(F.lit(1)).alias("degree"), F.min("owner").alias("candidate"))
    )
    open_pairs = exact.filter(F.col("how").isNull())
    candidates = (
        open_pairs.select("capture_id", "peers", F.explode(F.array_distinct(F.array("low", "high"))).alias("address"))
        .join(by_address, ["capture_id", "address"])
        .groupBy("capture_id", "peers")
        .agg(F.sum("degree").alias("candidates"), F.min("candidate").alias("candidate"))
    )
    resolved = exact.join(candidates, ["capture_id", "peers"], "left")
    owner = F.when(F.col("how").isNotNull(), F.col("peers")).when(F.col("candidates") == 1, F.col("candidate"))
    verdict = (
        F.when(F.col("how").isNotNull(), "exact")
        .when(F.col("candidates") == 1, "nat")
        .when(F.col("candidates") > 1, "ambiguous")
        .otherwise("none")
    )
    return resolved.select("capture_id", "peers", "low", "high", "pair_packets", owner.alias("owner"), verdict.alias("ownership"))


def own_packets(packets: DataFrame, associations: DataFrame) -> DataFrame:
    """Packets with ``peers``, ``owner`` (NULL for an orphan) and ``ownership``."""
    named = packets.withColumn("peers", peer_pair(F.col("src"), F.col("dst")))
    owners = pair_owners(packet_pairs(packets), sa_pairs(associations))
    facts = owners.select("capture_id", "peers", "pair_packets", "owner", "ownership")
    return attach(named, facts, ["capture_id", "peers"], "pair_packets", "inner").drop("pair_packets")


def anti_replay(owned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packets per key and whether sequence numbers advance (NULL when undecidable).

    One distinct sequence number means min = max, so no distinct count is needed.
    """
    spi, seq = F.coalesce("spi", F.lit(0)), F.coalesce("seq", F.lit(0))
    per_spi = owned.groupBy(*keys, spi.alias("_spi")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_lo"), F.max(seq).alias("_hi")
    )
    enough = F.col("_n") >= ANTI_REPLAY_MIN
    stuck = F.bool_or(enough & (F.col("_lo") == F.col("_hi")))
    return per_spi.groupBy(*keys).agg(
        F.sum("_n").alias("esp_packets"), F.when(stuck, False).when(F.bool_or(enough), True).alias("anti_replay")
    )


def esp_per_association(associations: DataFrame, packets: DataFrame) -> DataFrame:
    """ESP packet count and anti-replay verdict of every association.

    Every association of an owner pair holds the same packets, so packets are aggregated per
    owner pair first and only those small rows fan out.
    """
    owned = own_packets(packets, associations).filter(F.col("owner").isNotNull())
    facts = anti_replay(owned, ["capture_id", "owner"])
    keyed = associations.withColumn("owner", peer_pair(F.col("initiator_ip"), F.col("responder_ip")))
    counts = sa_pairs(associations).select("capture_id", "owner", "sa_count")
    joined = attach(keyed, counts.join(facts, ["capture_id", "owner"], "left"), ["capture_id", "owner"], "sa_count")
    return joined.withColumn("esp_packets", F.coalesce("esp_packets", F.lit(0))).drop("sa_count")


def orphan_packets(packets: DataFrame, associations: DataFrame) -> DataFrame:
    return own_packets(packets, associations).filter(F.col("owner").isNull())


def _orphan_id(first_spi: Column) -> Column:
    return F.concat(F.lit("esp-"), F.lower(F.lpad(F.hex(first_spi), 8, "0")))


def orphan_evidence(orphans: DataFrame) -> DataFrame:
    """Every frame and size of packets without an association, beside the id of their mid-session record; long, as ``evidence_frames``."""
    keys = ["capture_id", "peers"]
    facts = orphans.groupBy(*keys).agg(F.min_by(F.coalesce("spi", F.lit(0)), "frame").alias("_spi"), F.count(F.lit(1)).alias("_n"))
    return attach(orphans.select(*keys, "frame", "size"), facts, keys, "_n").select(*keys, _orphan_id(F.col("_spi")).alias("session_id"), "frame", "size")


def mid_session_records(orphans: DataFrame, compat: bool = False, refs: int = MID_SESSION_REFS) -> DataFrame:
    """One record per unordered pair whose packets no association owns.

    A record shows its first ``refs`` frames: a top-k the window operator applies before the
    shuffle; ``orphan_evidence`` holds all. ``compat=True`` reports IPv4 always, as a record without a handshake used to.
    """
    from pyspark.sql import Window

    keys = ["capture_id", "peers"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    first = orphans.withColumn("_rank", rank).filter(F.col("_rank") <= refs)
    head = first.groupBy(*keys).agg(
        F.min_by(F.struct(F.coalesce("spi", F.lit(0)).alias("spi"), "src", "dst"), "frame").alias("_first"),
        F.array_sort(F.collect_list("frame")).alias("packet_refs"),
    )
    version = F.lit("IPv4") if compat else F.when(F.col("_first.src").contains(":"), "IPv6").otherwise("IPv4")
    unknown = F.lit("unknown")
    return head.join(anti_replay(orphans, keys), keys).select(
        *keys,
        _orphan_id(F.col("_first.spi")).alias("session_id"),
        F.col("_first.src").alias("initiator_ip"), F.col("_first.dst").alias("responder_ip"),
        version.alias("ip_version"), F.lit("IKEv2").alias("version"),
        unknown.alias("encryption"), unknown.alias("integrity"), unknown.alias("prf"), unknown.alias("dh_group"),
        unknown.alias("pfs_status"), F.lit(False).alias("complete"),
        "packet_refs", "esp_packets", "anti_replay",
    )


def ingest_summary(associations: DataFrame, packets: DataFrame) -> DataFrame:
    """Counters per capture."""
    per_sa = associations.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.array_join(F.array_sort(F.collect_set("version")), ",").alias("ike_versions"),
        F.count_if(~F.col("complete")).alias("incomplete"),
        F.count_if("nat_traversal").alias("nat_traversal"),
    )
    per_capture = packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("esp_packets"))
    return per_sa.join(per_capture, "capture_id", "full").select(
        "capture_id",
        F.coalesce("session_count", F.lit(0)).alias("session_count"),
        F.coalesce("ike_versions", F.lit("")).alias("ike_versions"),
        F.coalesce("incomplete", F.lit(0)).alias("incomplete"),
        F.coalesce("nat_traversal", F.lit(0)).alias("nat_traversal"),
        (F.coalesce("esp_packets", F.lit(0)) > 0).alias("has_esp"),
    )


def flagged_sessions(associations: DataFrame) -> DataFrame:
    """Long list of sessions that are incomplete or used NAT traversal."""
    flags = F.filter(
        F.array(F.when(~F.col("complete"), F.lit("incomplete")), F.when(F.col("nat_traversal"), F.lit("nat_traversal"))),
        lambda x: x.isNotNull(),
    )
    return associations.select(*SA, "session_id", F.explode(flags).alias("flag"))


def capture_stats(messages: DataFrame, packets: DataFrame) -> DataFrame:
    """Packets, duration (in frame order, never negative), sessions, orphans of each capture."""
    both = messages.select("capture_id", "frame", "t_us", F.lit(1).alias("_ike")).unionByName(
        packets.select("capture_id", "frame", "t_us", F.lit(0).alias("_ike"))
    )
    order = F.struct("frame", "_ike")
    totals = both.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("_ike").cast("bigint").alias("ike_packets"),
        (F.max_by("t_us", order) - F.min_by("t_us", order)).alias("_span"),
    )
    associations = group_messages(messages)
    per_sa = associations.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("_sas"), F.count_if(~F.col("complete")).alias("_incomplete")
    )
    owners = pair_owners(packet_pairs(packets), sa_pairs(associations))
    orphans = owners.filter(F.col("owner").isNull()).groupBy("capture_id").agg(
        F.sum("pair_packets").alias("_orphans"), F.count(F.lit(1)).alias("_mid")
    )
    zero = F.lit(0)
    return (
        totals.join(per_sa, "capture_id", "left")
        .join(orphans, "capture_id", "left")
        .select(
            "capture_id", "packets", "ike_packets", (F.col("packets") - F.col("ike_packets")).alias("esp_packets"),
            F.greatest(F.col("_span"), F.lit(0)).alias("duration_us"),
            (F.coalesce("_sas", zero) + F.coalesce("_mid", zero)).alias("sessions"),
            (F.coalesce("_incomplete", zero) + F.coalesce("_mid", zero)).alias("incomplete_sessions"),
            F.coalesce("_orphans", zero).alias("orphan_esp_packets"),
        )
    )


def ipsec_only(packets: DataFrame) -> DataFrame:
    """Keep ESP, AH and key-exchange datagrams; pushed to the scan before any exchange."""
    condition = F.col("proto").isin(50, 51)
    if "udp_port" in packets.columns:
        condition = condition | ((F.col("proto") == 17) & F.col("udp_port").isin(500, 4500))
    return packets.filter(condition)
