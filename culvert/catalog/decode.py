"""Decoding queries: the stand-ins as bytes, decoded again, beside the columns that the bytes were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.associations import IKE
from culvert.plans import standins as S
from culvert.plans.wire import with_frames, with_messages, write_captures
from culvert.session import shared_dir
from culvert.sources import headers, ike, splits

V2 = "version = 'IKEv2'"


def given(kind: int, kind_1: int | None = None) -> str:
    v1 = f" OR version = 'IKEv1' AND list_contains(payload_types, {kind_1})" if kind_1 else ""
    return f"({V2} AND list_contains(payload_types, {kind}){v1})"


def decoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = with_messages(S.ike_messages(spark, sf_dir)).select("capture_id", "frame", "t_us", F.lit("IPv4").alias("ip_version"), "src", "dst", "udp_port", "ike")
    found = ike.decode_messages(raw)
    lists = {name: F.array_join(name, ",") for name in ("payload_types", "addke_ids", "notify_types", "vids")}
    return found.withColumns(lists).drop("length", "ip_version", "cert_subject", "cert_issuer", "cert_not_after_us")


PHASE_1 = "(version = 'IKEv1' AND list_contains(payload_types, 1) AND exchange <> 32)"
QUICK = "(version = 'IKEv1' AND list_contains(payload_types, 1) AND exchange = 32)"
ANY_1 = f"({PHASE_1} OR {QUICK})"
TRANSFORMS = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ("encr_id", "integ_id", "prf_id", "dh_id"))

add(
    "decoded_messages",
    decoded_messages,
    f"""WITH {IKE} SELECT capture_id, init_spi, resp_spi, frame, t_us, version, exchange, is_response, message_id, src, dst, udp_port,
    array_to_string(payload_types, ',') AS payload_types, FALSE AS truncated, FALSE AS encrypted, CAST(NULL AS VARCHAR) AS error,
    CASE WHEN {given(33)} THEN proposal_protocol END AS proposal_protocol, CASE WHEN {given(33)} THEN encr_id END AS encr_id,
    CASE WHEN {given(33)} AND encr_id IS NOT NULL OR {ANY_1} THEN key_length END AS key_length,
    CASE WHEN {given(33)} THEN integ_id END AS integ_id, CASE WHEN {given(33)} THEN prf_id END AS prf_id, CASE WHEN {given(33)} THEN dh_id END AS dh_id,
    CASE WHEN {given(33)} THEN array_to_string(addke_ids, ',') ELSE '' END AS addke_ids,
    CASE WHEN {given(33)} THEN CAST({TRANSFORMS} + len(addke_ids) AS BIGINT) ELSE 0 END AS n_transforms,
    CASE WHEN {given(34)} THEN coalesce(ke_group, 0) END AS ke_group, CASE WHEN {given(34)} THEN ke_len ELSE 0 END AS ke_len,
    CASE WHEN {given(39)} THEN auth_id END AS auth_id,
    CASE WHEN {given(41)} THEN CAST(coalesce(notify_types[1], 16384) AS VARCHAR) ELSE '' END AS notify_types,
    CASE WHEN {given(43, 13)} THEN vid_hex ELSE '' END AS vids,
    {', '.join(f'CASE WHEN {PHASE_1} THEN {c} END AS {c}' for c in ('v1_encr', 'v1_hash', 'v1_auth', 'v1_group'))},
    {', '.join(f'CASE WHEN {ANY_1} THEN {c} END AS {c}' for c in ('life_type', 'life_value'))},
    {', '.join(f'CASE WHEN {QUICK} THEN {c} END AS {c}' for c in ('esp_id', 'esp_auth', 'p2_group', 'encap'))}
    FROM ike""",
)

add(
    "decoded_packets",
    lambda spark, d: headers.split_packets(headers.decode_headers(with_frames(S.esp_packets(spark, d)).select("capture_id", "frame", "t_us", F.lit(1).alias("link"), "data")))[0],
    f"""WITH {S.duck_cte('esp')} SELECT capture_id, frame, t_us, size, src, dst, proto, spi, CASE WHEN spi IS NOT NULL THEN seq END AS seq
    FROM esp WHERE proto IN (50, 51)""",
)


def captured_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet stand-in written as capture files, scanned in byte ranges and decoded from the link layer up."""
    path = f"{shared_dir(spark, 'captures')}-{uuid.uuid4().hex}"
    write_captures(with_frames(S.esp_packets(spark, sf_dir)), path)
    packets, _ = headers.split_packets(headers.decode_headers(splits.read_captures(spark, path)))
    return packets.drop("capture_id", "frame")


add(
    "captured_packets",
    captured_packets,
    f"""WITH {S.duck_cte('esp')} SELECT t_us, size, src, dst, proto, spi, CASE WHEN spi IS NOT NULL THEN seq END AS seq
    FROM esp WHERE proto IN (50, 51)""",
)
