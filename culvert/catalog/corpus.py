"""Corpus queries. Configurations and classes come from the session stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.flows import BASE, ESP, packets
from culvert.catalog.rules import SESS
from culvert.operators import corpus as O
from culvert.plans import standins as S

DIMS = ["mode", "cipher", "dh_group", "pfs", "ip_version"]
CIPHER = "CASE encryption WHEN 'AES-256-GCM' THEN 'aes256gcm' WHEN 'AES-128-GCM' THEN 'aes128gcm' WHEN 'AES-256-CBC' THEN 'aes256cbc_sha256' WHEN '3DES-CBC' THEN '3descbc_sha1' WHEN 'DES-CBC' THEN 'descbc_md5' ELSE 'unknown' END"
PARTS = {"mode": "mode", "cipher": CIPHER, "dh_group": "lower(dh_group)", "pfs": "CASE pfs_status WHEN 'enabled' THEN 'pfs' ELSE 'nopfs' END", "ip_version": "lower(ip_version)"}
CELLS = (
    "cells0 AS (SELECT *, predicted_type AS label, " + ", ".join(f"{e} AS c_{k}" for k, e in PARTS.items()) + " FROM sess), "
    "cells AS (SELECT row_no, session_id, label, " + ", ".join(f"c_{k} AS {k}" for k in DIMS) + ", concat_ws('_', " + ", ".join(f"c_{k}" for k in DIMS) + ") AS config FROM cells0)"
)


def cells(s, d):
    flat = S.sessions(s, d).select("row_no", "session_id", "ike.mode", "ike.encryption", "ike.dh_group", "ike.pfs_status", "ike.ip_version", F.col("traffic.predicted_type").alias("label"))
    out = flat.select("row_no", "session_id", "label", *[F.expr(e).alias(k) for k, e in PARTS.items()])
    return out.withColumn("config", F.concat_ws("_", *DIMS))


C = f"WITH {SESS}, {CELLS}"


def _grid(s, d):
    seen = cells(s, d).groupBy("config").agg(F.count(F.lit(1)).alias("sessions"))
    return O.config_grid(s).join(seen, "config", "left").select("config", F.coalesce("sessions", F.lit(0)).alias("sessions"))


_grid_sql = " CROSS JOIN ".join(
    "(VALUES " + ", ".join(f"('{v}')" for v in vs) + f") AS t{i}({n})"
    for i, (n, vs) in enumerate((("mode", O.GRID_MODES), ("cipher", O.GRID_CIPHERS), ("dh_group", O.GRID_GROUPS), ("pfs", O.GRID_PFS), ("ip_version", O.GRID_IP)))
)
add(
    "config_grid_coverage",
    _grid,
    f"{C}, grid AS (SELECT concat_ws('_', mode, cipher, dh_group, pfs, ip_version) AS config FROM {_grid_sql}) SELECT config, count(row_no) AS sessions FROM grid LEFT JOIN cells USING (config) GROUP BY config",
)
STRATA = "st AS (" + " UNION ALL ".join(f"SELECT DISTINCT label, config, '{k}' AS dimension, {k} AS value FROM cells" for k in ("cipher", "dh_group", "pfs")) + ")"
add(
    "stratified_sample",
    lambda s, d: O.stratified_sample(cells(s, d), ["cipher", "dh_group", "pfs"], 300, 11),
    f"""{C}, {STRATA}, pk AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY label, dimension, value ORDER BY md5('11|' || label || '|' || dimension || '|' || value || '|' || config), config) = 1),
fo AS (SELECT DISTINCT config, label FROM pk), al AS (SELECT DISTINCT config, label FROM cells)
SELECT al.config, al.label, fo.label IS NOT NULL AS forced FROM al LEFT JOIN fo ON al.config = fo.config AND al.label = fo.label ORDER BY fo.label IS NULL, md5('11|' || al.label || '|' || al.config), al.config, al.label LIMIT 300""",
)
add(
    "cells_from_labels",
    lambda s, d: O.cells_from_labels(cells(s, d).select(F.concat("config", F.lit("__"), F.lower("label")).alias("name")), O.config_grid(s))[0].groupBy("config").agg(F.count(F.lit(1)).alias("labels")),
    f"{C}, grid AS (SELECT concat_ws('_', mode, cipher, dh_group, pfs, ip_version) AS config FROM {_grid_sql}) SELECT config, count(*) AS labels FROM cells WHERE config IN (SELECT config FROM grid) GROUP BY config",
)
add(
    "cells_without_config",
    lambda s, d: O.cells_from_labels(cells(s, d).select(F.concat("config", F.lit("__"), F.lower("label")).alias("name")), O.config_grid(s))[1].groupBy("config").agg(F.count(F.lit(1)).alias("labels")),
    f"{C}, grid AS (SELECT concat_ws('_', mode, cipher, dh_group, pfs, ip_version) AS config FROM {_grid_sql}) SELECT config, count(*) AS labels FROM cells WHERE config NOT IN (SELECT config FROM grid) GROUP BY config",
)


def _names(s, d, table, col):
    return s.read.parquet(f"{d}/{table}.parquet").select(F.concat(F.lit("cap-"), F.col(col).cast("string")).alias("name"))


def _labels(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("cap-"), (F.col("o_custkey") + 5).cast("string")).alias("name"))


LBL = "lb AS (SELECT DISTINCT 'cap-' || (o_custkey + 5) AS name FROM orders), mf AS (SELECT DISTINCT 'cap-' || c_custkey AS name FROM customer)"
add(
    "manifest_reconcile",
    lambda s, d: O.reconcile_manifest(_labels(s, d), _names(s, d, "customer", "c_custkey")),
    f"WITH {LBL} SELECT name, 'label without manifest entry' AS problem FROM lb WHERE name NOT IN (SELECT name FROM mf) UNION ALL SELECT name, 'manifest entry without label' FROM mf WHERE name NOT IN (SELECT name FROM lb)",
)
add(
    "remaining_cells",
    lambda s, d: O.remaining_cells(_names(s, d, "customer", "c_custkey"), _labels(s, d)),
    f"WITH {LBL} SELECT name FROM mf WHERE name NOT IN (SELECT name FROM lb)",
)
add(
    "accepted_captures",
    lambda s, d: O.accepted_captures(packets(s, d), ["capture_id", "spi_hex"]),
    f"WITH {ESP}, {BASE} SELECT capture_id, spi_hex, count(*) AS packets FROM base GROUP BY ALL HAVING count(*) >= 20",
)
add(
    "class_balance",
    lambda s, d: O.class_balance(cells(s, d), "label", (*O.CLASSES, "Other")),
    f"{C}, c AS (SELECT label, count(*) AS n FROM cells GROUP BY 1) SELECT sum(n)::BIGINT AS total, min(n) AS smallest, count(*) AS classes, sum(n) >= 300 AS big_enough, count(*) = 7 AS all_classes, min(n) * 2 >= sum(n) / count(*) AS balanced FROM c",
)
ALLC = (*O.CLASSES, "Other")


def _crosstab(s, d):
    """The class Other and the rest in no class, other, differ in case alone: the caller's session must tell them apart, also to read the result back."""
    s.conf.set("spark.sql.caseSensitive", "true")
    return O.coverage(cells(s, d), DIMS, "label", ALLC)


add(
    "coverage_crosstab",
    _crosstab,
    f"{C}, l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, label FROM cells" for k in DIMS) + ") SELECT dimension, value, "
    + ", ".join(f"count(*) FILTER (label = '{c}') AS \"{c}\"" for c in ALLC) + ", count(*) FILTER (label IS NULL OR label NOT IN (" + ", ".join(f"'{c}'" for c in ALLC) + ")) AS other FROM l GROUP BY dimension, value",
)


def _accuracy(s, d):
    parsed = S.sessions(s, d).select(F.substring("session_id", 1, 16).alias("key"), "ike.mode", "ike.pfs_status", "ike.auth_method", "ike.version")
    truth = S.gateway_records(s, d).select(F.lower(F.lpad(F.hex("rec_ix"), 16, "0")).alias("key"), "mode", "pfs_status", "auth_method", "version")
    return O.field_accuracy(parsed, truth, "key", ["mode", "pfs_status", "auth_method", "version"])


add(
    "field_accuracy",
    _accuracy,
    f"WITH {SESS}, {S.duck_cte('gw')}, j AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, s.{f} IS NOT DISTINCT FROM g.{f} AS same FROM sess s JOIN gw g ON substr(s.session_id, 1, 16) = lpad(lower(to_hex(g.rec_ix)), 16, '0')" for f in ("mode", "pfs_status", "auth_method", "version"))
    + ") SELECT field, count(*) AS compared, count(*) FILTER (same) AS correct, count(*) FILTER (same)::DOUBLE / count(*)::DOUBLE AS accuracy FROM j GROUP BY field",
)
# What to look for: cipher, key exchange group and class, as parts of a capture name.
WANTED = [("aes128gcm", "modp2048", "chat"), ("descbc_md5", "ecp256", "web"), ("aes256cbc_sha256", "modp1024", "icmp"), ("aes256gcm", "ecp256", "email")]
add(
    "first_matches",
    lambda s, d: O.first_matches(cells(s, d).select(F.concat("config", F.lit("__"), F.lower("label")).alias("name")), WANTED, only="ipv4"),
    f"{C}, nm AS (SELECT DISTINCT config || '__' || lower(label) AS name FROM cells WHERE contains(config, 'ipv4')) " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT {i} AS position, '{'/'.join(w)}' AS wanted, name AS picked FROM nm WHERE contains(name, '{w[0]}') AND contains(name, '{w[1]}') AND name LIKE '%\\_\\_{w[2]}' ESCAPE '\\' ORDER BY name LIMIT 1)" for i, w in enumerate(WANTED)),
)


def _readdress(s, d):
    p = packets(s, d).select("capture_id", "peers", "frame", "src", "dst")
    return O.readdress(p, ["capture_id", "peers"], F.concat(F.lit("10.20."), F.col("capture_id").cast("string"), F.lit(".10")), F.concat(F.lit("10.20."), F.col("capture_id").cast("string"), F.lit(".20")))


add(
    "readdressed_packets",
    _readdress,
    f"""WITH {ESP}, {BASE}, l AS (SELECT *, first_value(src) OVER (PARTITION BY capture_id, peers ORDER BY frame) AS f FROM base)
SELECT capture_id, peers, frame, '10.20.' || capture_id || CASE WHEN src = f THEN '.10' ELSE '.20' END AS src, '10.20.' || capture_id || CASE WHEN dst = f THEN '.10' ELSE '.20' END AS dst FROM l""",
)
