"""Negotiated parameters of an association, as ordered aggregates over its messages.

"First" and "last" always mean first and last by ``frame``; ``min_by``/``max_by`` skip rows whose
ordering value is NULL, so a condition is written as ``when(condition, frame)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culvert.functions import codes as C
from culvert.functions.numeric import half_even
from culvert.operators.associations import FRAGMENT_TYPES, SA, has_payload
from culvert.plans.skew import attach, exact_median, slice_of

SA_INIT, IKE_AUTH, CREATE_CHILD, INFORMATIONAL = 34, 35, 36, 37
QUICK, AGGRESSIVE = 32, 4
TRANSPORT_NOTIFY = 16391


def unknown() -> Column:
    return F.lit("unknown")

GAP_SLICE_US = 3_600_000_000
MEDIAN_BAND_US = 1_000_000


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when & value.isNotNull(), F.col("frame")))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when & value.isNotNull(), F.col("frame")))


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def canonical_names(messages: DataFrame) -> DataFrame:
    """Canonical names of every message's registry numbers, both protocol versions."""
    aead = C.is_aead(F.col("encr_id"))
    dh = C.dh_group(F.col("dh_id"))
    return messages.select(
        *SA, "frame",
        C.v2_encryption(F.col("encr_id"), F.col("key_length")).alias("encryption"),
        C.v2_integrity(F.col("integ_id"), aead).alias("integrity"),
        C.v2_prf(F.col("prf_id")).alias("prf"),
        dh.alias("dh_group"),
        C.v2_auth(F.col("auth_id"), has_payload(48)).alias("auth_method"),
        C.pqc_status(dh, additional_groups(F.col("addke_ids"))).alias("pqc_status"),
        C.v1_encryption(F.col("v1_encr"), F.col("key_length")).alias("v1_encryption"),
        C.v1_integrity(F.col("v1_hash")).alias("v1_integrity"),
        C.v1_prf(F.col("v1_hash")).alias("v1_prf"),
        C.v1_auth(F.col("v1_auth")).alias("v1_auth_method"),
        C.esp_encryption(F.col("esp_id"), F.col("key_length")).alias("esp_encryption"),
        C.esp_integrity(F.col("esp_auth")).alias("esp_integrity"),
        C.vendor_of(F.col("vid_hex")).alias("vendor"),
    )


def additional_groups(ids: Column) -> Column:
    """Names of additional key exchanges in order, NONE dropped, repeats dropped."""
    return F.array_distinct(F.transform(F.filter(ids, lambda i: i != 0), C.dh_group))


def flatten_payloads(messages: DataFrame) -> DataFrame:
    """One row per payload of a message, in order."""
    return messages.select(*SA, "frame", F.posexplode("payload_types").alias("position", "payload_type"))


def accepted_proposal(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """Accepted version-2 proposal per association.

    Replies overlay requests field by field and a later message overwrites an earlier one;
    requests after the first reply that carries a proposal are ignored.
    """
    keys = list(keys)
    opening = messages.filter((F.col("version") == "IKEv2") & (F.col("exchange") == SA_INIT))
    proposed = has_payload(33)
    reply = F.col("is_response") & proposed
    first_reply = opening.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(reply, F.col("frame"))).alias("_reply_at")
    )
    rows = attach(opening, first_reply, keys, "_n", "inner")
    counts = proposed & (F.col("is_response") | F.col("_reply_at").isNull() | (F.col("frame") < F.col("_reply_at")))
    aead = C.is_aead(F.col("encr_id"))
    fields = {
        "encryption": C.v2_encryption(F.col("encr_id"), F.col("key_length")),
        "integrity": C.v2_integrity(F.col("integ_id"), aead),
        "prf": C.v2_prf(F.col("prf_id")),
        "dh_proposed": C.dh_group(F.col("dh_id")),
        "additional": additional_groups(F.col("addke_ids")),
    }
    ke = C.dh_group(F.when(has_payload(34), F.col("ke_group")))
    return rows.groupBy(*keys).agg(
        *[F.coalesce(_last(v, counts & F.col("is_response")), _last(v, counts & ~F.col("is_response"))).alias(k) for k, v in fields.items()],
        _first(ke, F.lit(True)).alias("dh_from_ke"),
        _any(reply).alias("saw_reply"),
    )


def child_negotiations(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """Facts of IKE_AUTH and CREATE_CHILD_SA: authentication, mode, forward secrecy."""
    v2 = messages.filter((F.col("version") == "IKEv2") & F.col("exchange").isin(IKE_AUTH, CREATE_CHILD))
    in_auth, in_child = F.col("exchange") == IKE_AUTH, F.col("exchange") == CREATE_CHILD
    has_auth, eap = has_payload(39), has_payload(48)
    child = has_payload(33) & F.col("proposal_protocol").isin(2, 3)
    keyed = has_payload(34) | (F.coalesce(F.col("dh_id"), F.lit(0)) != 0)
    auth = F.when(has_auth | eap, C.v2_auth(F.when(has_auth, F.col("auth_id")), eap))
    transport = has_payload(41) & F.array_contains("notify_types", TRANSPORT_NOTIFY)
    return v2.groupBy(*keys).agg(
        _last(auth, in_auth).alias("auth_method"),
        _any(in_auth & transport).alias("saw_transport"),
        _any(in_auth & (has_auth | eap | child)).alias("saw_readable_auth"),
        _any(child & keyed).alias("child_keyed"),
        _any(in_child & child).alias("saw_rekey"),
        _any(in_auth & child).alias("saw_auth_child"),
    )


def vendor_ids(messages: DataFrame) -> Column:
    """Vendor ID payloads of a message in order, as lower-case hex."""
    if "vids" in messages.columns:
        return F.transform("vids", F.lower)
    one = F.when(has_payload(43, 13) & F.col("vid_hex").isNotNull(), F.array(F.lower("vid_hex")))
    return F.coalesce(one, F.array().cast("array<string>"))


def signals(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """Vendor, fragmentation, NAT and dead-peer-detection facts of every association."""
    vids = vendor_ids(messages)
    vendor = F.get(F.filter(F.transform(vids, C.vendor_of), lambda v: v.isNotNull()), 0)
    announces_dpd = F.exists(vids, lambda v: v.startswith(C.DPD_VENDOR_PREFIX))
    v1 = F.col("version") == "IKEv1"
    liveness = ~v1 & (F.col("exchange") == INFORMATIONAL) & (F.size("payload_types") == 0)
    return messages.groupBy(*keys).agg(
        F.min_by("version", "frame").alias("version"),
        _first(vendor, F.lit(True)).alias("_vendor"),
        _any(has_payload(*FRAGMENT_TYPES)).alias("fragmented_ike"),
        _any((F.col("udp_port") == 4500) | (v1 & has_payload(20, 130))).alias("nat_traversal"),
        _any(announces_dpd | liveness).alias("dpd_seen"),
    ).withColumn("vendor", F.coalesce("_vendor", unknown())).drop("_vendor")


def v2_parameters(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    keys = list(keys)
    v2 = messages.filter(F.col("version") == "IKEv2")
    opened = v2.groupBy(*keys).agg(_any(F.col("exchange") == SA_INIT).alias("saw_init"))
    j = (
        opened.join(accepted_proposal(v2, keys), keys, "left")
        .join(child_negotiations(v2, keys), keys, "left")
        .join(signals(v2, keys).drop("version"), keys, "left")
    )
    complete = F.coalesce("saw_reply", F.lit(False)) | (F.col("saw_init") & F.col("encryption").isNotNull())
    dh = F.coalesce("dh_proposed", "dh_from_ke")
    true = F.lit(True)
    return j.select(
        *keys,
        F.lit("IKEv2").alias("version"),
        F.lit(False).alias("aggressive_mode"),
        F.coalesce("encryption", unknown()).alias("encryption"),
        F.coalesce("integrity", unknown()).alias("integrity"),
        F.coalesce("prf", unknown()).alias("prf"),
        F.coalesce(dh, unknown()).alias("dh_group"),
        F.array_join(F.coalesce("additional", F.array().cast("array<string>")), ",").alias("additional_key_exchanges"),
        "auth_method",
        F.when(F.col("saw_transport") == true, "transport").when(F.col("saw_readable_auth") == true, "tunnel").otherwise("unknown").alias("mode"),
        F.when(F.col("child_keyed") == true, "enabled")
        .when(F.col("saw_rekey") == true, "disabled")
        .when(complete & (F.col("saw_auth_child") == true), "disabled")
        .otherwise("unknown").alias("pfs_status"),
        F.lit(None).cast("bigint").alias("sa_lifetime_sec"),
        complete.alias("capture_complete"),
        "vendor", "fragmented_ike", "nat_traversal",
        F.when(F.col("dpd_seen"), "enabled").otherwise("unknown").alias("dpd_status"),
        C.pqc_status(dh, F.col("additional")).alias("pqc_status"),
    )


def v1_parameters(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """Version-1 parameters: phase 1 from the opening message, overridden by Quick Mode."""
    keys = list(keys)
    v1 = messages.filter(F.col("version") == "IKEv1")
    sa = has_payload(1)
    opening = sa & (F.col("message_id") == 0)
    quick = sa & (F.col("exchange") == QUICK)
    phase1 = F.struct("exchange", has_payload(5).alias("has_id"), "v1_encr", "key_length", "v1_hash", "v1_auth", "v1_group", "life_type", "life_value")
    phase2 = F.struct(has_payload(4).alias("has_ke"), "esp_id", "key_length", "esp_auth", "p2_group", "encap", "life_type", "life_value")
    g = v1.groupBy(*keys).agg(
        _first(phase1, opening).alias("open"),
        _first(phase1, sa & (F.col("exchange") != QUICK)).alias("other"),
        _first(phase2, quick).alias("qm"),
        _any(F.col("exchange") == AGGRESSIVE).alias("any_aggressive"),
    )
    g = g.withColumn("p1", F.coalesce("open", "other")).join(signals(v1, keys).drop("version"), keys, "left")

    def seconds(part: str) -> Column:
        return F.when(F.col(f"{part}.life_type").isNull() | (F.col(f"{part}.life_type") == 1), F.col(f"{part}.life_value"))

    qm_group = F.when(F.coalesce("qm.p2_group", F.lit(0)) != 0, C.dh_group(F.col("qm.p2_group")))
    dh = F.coalesce(qm_group, C.dh_group(F.col("p1.v1_group")))
    aggressive = F.when(
        F.col("open").isNotNull(), F.col("open.has_id") | (F.col("open.exchange") == AGGRESSIVE)
    ).otherwise(F.col("any_aggressive"))
    complete = F.col("open").isNotNull()
    return g.select(
        *keys,
        F.lit("IKEv1").alias("version"),
        aggressive.alias("aggressive_mode"),
        F.coalesce(C.esp_encryption(F.col("qm.esp_id"), F.col("qm.key_length")), C.v1_encryption(F.col("p1.v1_encr"), F.col("p1.key_length")), unknown()).alias("encryption"),
        F.coalesce(C.esp_integrity(F.col("qm.esp_auth")), C.v1_integrity(F.col("p1.v1_hash")), unknown()).alias("integrity"),
        F.coalesce(C.v1_prf(F.col("p1.v1_hash")), unknown()).alias("prf"),
        F.coalesce(dh, unknown()).alias("dh_group"),
        F.lit("").alias("additional_key_exchanges"),
        C.v1_auth(F.col("p1.v1_auth")).alias("auth_method"),
        F.when(F.col("qm.encap").isin(2, 4), "transport").when(F.col("qm.encap").isin(1, 3), "tunnel").otherwise("unknown").alias("mode"),
        F.when(F.col("qm").isNull(), "unknown")
        .when(F.col("qm.has_ke") | (F.coalesce("qm.p2_group", F.lit(0)) != 0), "enabled")
        .otherwise("disabled").alias("pfs_status"),
        F.coalesce(seconds("qm"), seconds("p1")).alias("sa_lifetime_sec"),
        complete.alias("capture_complete"),
        "vendor", "fragmented_ike", "nat_traversal",
        F.when(F.col("dpd_seen"), "enabled").when(complete, "disabled").otherwise("unknown").alias("dpd_status"),
        C.pqc_status(dh, F.array().cast("array<string>")).alias("pqc_status"),
    )


def parameters(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """Parameters of every association, either version."""
    return v2_parameters(messages, keys).unionByName(v1_parameters(messages, keys))


def retransmit_interval(
    messages: DataFrame, keys: Sequence[str] = SA, v1_by_direction: bool = False, slice_us: int = GAP_SLICE_US
) -> DataFrame:
    """Median positive gap (ms) between identical messages; NULL under two gaps.

    Version 1 never marks a reply, so a request and its answer count as identical unless
    ``v1_by_direction`` adds the sender to the key.
    """
    keys = list(keys)
    same = [*keys, "exchange", "message_id", "is_response", "_side"]
    rows = messages.filter("t_us IS NOT NULL").withColumn("_side", F.when(F.lit(v1_by_direction) & (F.col("version") == "IKEv1"), F.col("src")))
    # gaps inside a slice, and those from the end of a slice to the next one's start: both read one exchange
    rows = rows.select(*same, "t_us", slice_of(F.col("t_us"), slice_us).alias("_slice")).repartition(*same, "_slice")
    inner, across = Window.partitionBy(*same, "_slice").orderBy("t_us"), Window.partitionBy(*same).orderBy("_slice")
    inside = rows.select(*keys, (F.col("t_us") - F.lag("t_us").over(inner)).alias("gap"))
    ends = rows.groupBy(*same, "_slice").agg(F.min("t_us").alias("_from"), F.max("t_us").alias("_to"))
    between = ends.select(*keys, (F.col("_from") - F.lag("_to").over(across)).alias("gap"))
    gaps = inside.unionByName(between).filter("gap > 0")
    middle = exact_median(gaps, keys, "gap", MEDIAN_BAND_US)
    return (
        messages.select(*keys).distinct().join(middle, keys, "left")
        .select(*keys, F.when(F.col("n") >= 2, half_even(F.col("median") / 1000.0).cast("bigint")).alias("retransmit_interval_ms"))
    )


def certificate_facts(messages: DataFrame, as_of_us: int, keys: Sequence[str] = SA) -> DataFrame:
    """First readable certificate of an association, judged at an explicit instant."""
    readable = F.col("cert_subject").isNotNull()
    cert = F.struct("cert_subject", "cert_issuer", "cert_not_after_us")
    first = messages.groupBy(*keys).agg(_first(cert, readable).alias("c")).filter(F.col("c").isNotNull())
    return first.select(
        *keys,
        F.col("c.cert_subject").alias("subject"), F.col("c.cert_issuer").alias("issuer"),
        F.col("c.cert_not_after_us").alias("not_after_us"),
        (F.col("c.cert_not_after_us") < as_of_us).alias("expired"),
        (F.col("c.cert_subject") == F.col("c.cert_issuer")).alias("self_signed"),
    )


STRUCTURAL = ("sa_init_bytes", "ke_data_len", "n_payloads", "n_transforms", "has_ke", "has_nonce", "has_natd", "aead_hint", "keylen_attr")


def structural_features(messages: DataFrame, keys: Sequence[str] = SA) -> DataFrame:
    """Nine numbers read off the first IKE_SA_INIT, else off the first message."""
    body = F.struct("payload_types", "length", "ke_len", "n_transforms", "integ_id", "key_length")
    first = messages.groupBy(*keys).agg(
        F.min_by(body, F.struct((F.col("exchange") != SA_INIT).alias("late"), F.col("frame"))).alias("m"),
        _any(F.col("exchange") == SA_INIT).alias("has_sa_init"),
    )

    def has(t: int) -> Column:
        return F.array_contains("m.payload_types", t)

    transforms = F.when(has(33), F.col("m.n_transforms")).otherwise(F.lit(0))
    values = {
        "sa_init_bytes": F.col("m.length"),
        "ke_data_len": F.when(has(34), F.col("m.ke_len")).otherwise(0),
        "n_payloads": F.size("m.payload_types"),
        "n_transforms": transforms,
        "has_ke": has(34),
        "has_nonce": has(40),
        "has_natd": has(41),
        "aead_hint": (transforms > 0) & F.col("m.integ_id").isNull(),
        "keylen_attr": F.when(transforms > 0, F.coalesce("m.key_length", F.lit(0))).otherwise(0),
    }
    return first.select(*keys, "has_sa_init", *[v.cast("int").cast("double").alias(k) for k, v in values.items()])
