"""Gateway queries: status texts made from the gateway-record stand-in and read back, and reconcile over sessions and records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.rules import SCORE, SESS, TRIG, WORST, fired_sql
from culvert.operators import gateway as O
from culvert.operators import rules as RU
from culvert.plans import standins as S
from culvert.session import shared_dir

GW = S.duck_cte("gw")
FIELDS = ("mode", "pfs_status", "auth_method", "version", "anti_replay")
# matched (session, record) pairs, formed the plain way on the DuckDB side
PAIRS = """pm AS (SELECT s.row_no, g.* FROM sess s JOIN gw g ON (g.ike_spi_i IS NOT NULL AND starts_with(lower(s.session_id), g.ike_spi_i))
 UNION SELECT s.row_no, g.* FROM sess s JOIN gw g ON (g.local IS NOT NULL AND least(g.local, g.remote) = least(s.initiator_ip, s.responder_ip) AND greatest(g.local, g.remote) = greatest(s.initiator_ip, s.responder_ip)))"""
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT row_no, rec_ix, source, '{f}' AS field, {f}::VARCHAR AS value FROM pm WHERE {f} IS NOT NULL" for f in FIELDS) + ")"
FIRST = "fv AS (SELECT row_no, field, arg_min(value, rec_ix) AS value FROM lg GROUP BY ALL)"
WIRE = "wr AS (" + " UNION ALL ".join(f"SELECT row_no, '{f}' AS field, {f}::VARCHAR AS wire, {f} IS NULL OR {f}::VARCHAR = 'unknown' OR list_contains(inferred_fields, '{f}') AS hidden FROM sess" for f in FIELDS) + ")"
OUT = f"""{PAIRS}, {LONG}, {FIRST}, {WIRE},
nv AS (SELECT w.row_no, w.field, CASE WHEN hidden AND value IS NOT NULL THEN value ELSE wire END AS val, hidden AND value IS NOT NULL AS took FROM wr w LEFT JOIN fv USING (row_no, field)),
nt AS (SELECT DISTINCT l.row_no, l.field || ': wire ' || wire || ', ' || source || ' ' || value AS note FROM lg l JOIN wr w USING (row_no, field) WHERE NOT hidden AND value <> wire),
ns AS (SELECT row_no, string_agg(note, ';' ORDER BY note) AS mismatches, count(*) AS notes FROM nt GROUP BY 1),
rc AS (SELECT s.row_no, s.session_id, {', '.join(f"any_value(val) FILTER (field = '{f}') AS new_{f}" for f in FIELDS)},
 coalesce(string_agg(field, ',' ORDER BY list_position(['mode', 'pfs_status', 'auth_method', 'version', 'anti_replay'], field)) FILTER (took), '') AS filled,
 count(*) FILTER (took) AS nfilled, s.row_no IN (SELECT row_no FROM pm) AS matched FROM sess s JOIN nv USING (row_no) GROUP BY ALL)"""
G = f"WITH {SESS}, {GW}, {OUT}"


def reconciled(s, d):
    return O.reconcile(S.sessions(s, d), S.gateway_records(s, d))


def _flat(s, d):
    return reconciled(s, d).select(
        "row_no", "session_id", *[f"new_{f}" for f in FIELDS], F.array_join("filled", ",").alias("filled"),
        F.array_join("mismatches", ";").alias("mismatches"), "matched",
    )


add("gateway_reconcile", _flat, f"{G} SELECT rc.* EXCLUDE (nfilled), coalesce(mismatches, '') AS mismatches FROM rc LEFT JOIN ns USING (row_no)")
add(
    "gateway_mismatch_notes",
    lambda s, d: reconciled(s, d).select("row_no", F.explode("mismatches").alias("note")),
    f"{G} SELECT row_no, note FROM nt",
)
add("gateway_filled", lambda s, d: O.filled_counts(reconciled(s, d)), f"{G} SELECT field, count(*) AS sessions FROM nv WHERE took GROUP BY field")
UNM = "um AS (SELECT * FROM gw WHERE rec_ix NOT IN (SELECT rec_ix FROM pm))"
add(
    "gateway_unmatched",
    lambda s, d: O.unmatched_records(S.sessions(s, d), S.gateway_records(s, d)).select("rec_ix", "source", "local", "remote"),
    f"{G}, {UNM} SELECT rec_ix, source, local, remote FROM um",
)
add(
    "gateway_summary",
    lambda s, d: O.import_summary(S.sessions(s, d), S.gateway_records(s, d), reconciled(s, d)),
    f"""{G}, {UNM} SELECT (SELECT count(*) FROM gw) AS records, (SELECT count(DISTINCT session_id) FROM rc WHERE matched) AS matched_sessions,
 (SELECT sum(nfilled)::BIGINT FROM rc) AS filled, (SELECT count(*) FROM nt) AS mismatches, (SELECT count(*) FROM um) AS unmatched_records""",
)


def _rescored(s, d):
    after = RU.assess(O.apply_to_sessions(reconciled(s, d)))
    return after.select("row_no", "risk_score", "overall_severity", F.array_join("triggered_rules", ",").alias("triggered_rules"))


add(
    "gateway_rescored",
    _rescored,
    f"""{G}, s2 AS (SELECT sess.* REPLACE (new_mode AS mode, new_pfs_status AS pfs_status, new_auth_method AS auth_method, new_version AS version, new_anti_replay::BOOLEAN AS anti_replay,
 list_concat(gateway_mismatches, CASE WHEN notes > 0 THEN ['x'] ELSE [] END) AS gateway_mismatches) FROM sess JOIN rc USING (row_no) LEFT JOIN ns USING (row_no)), {fired_sql('s2')}
 SELECT row_no, {SCORE} AS risk_score, {WORST} AS overall_severity, {TRIG} AS triggered_rules FROM fired""",
)


# --- status texts ----------------------------------------------------------------------------------
#
# Each record of the stand-in is put down once in each format, with the values that the format can show.

TEXTS = {
    "list-sas": """concat_ws('\n', concat('gw', rec_ix, ': #', rec_ix, ', ESTABLISHED, ', coalesce(version, 'IKEv1'), ', ', lpad(lower(hex(rec_ix)), 16, '0'), '_i* ', lpad(lower(hex(rec_ix + 1)), 16, '0'), '_r'),
      concat('  local  ''here'' @ ', local, '[4500]'), concat('  remote ''there'' @ ', remote, '[4500]'), '  AES_CBC-256/HMAC_SHA2_256_128/PRF_HMAC_SHA2_256/CURVE_25519', '',
      concat('  net: #', rec_ix, ', reqid 1, INSTALLED, ', upper(mode), ', ESP:AES_CBC-256/HMAC_SHA2_256_128', if(pfs_status = 'enabled', '/CURVE25519', '')))""",
    "list-conns": """concat_ws('\n', concat('gw', rec_ix, ': ', coalesce(version, 'IKEv1'), ', no reauthentication, rekeying every 14400s'),
      concat('  local:  ', local), concat('  remote: ', remote), '  local pre-shared key authentication:', '    id: here',
      concat('  remote ', if(auth_method = 'PSK', 'pre-shared key', concat(auth_method, '-MSCHAPV2')), ' authentication:'), concat('  net: ', upper(mode), ', rekeying every 3600s'))""",
    "conf": """concat_ws('\n', 'connections {', concat('  gw', rec_ix, ' {'), concat('    local_addrs = ', local, ' # own end'), concat('    remote_addrs = ', coalesce(remote, '10.255.0.1'), ', 10.255.0.2'),
      concat('    version = ', if(version = 'IKEv2', '2', '1')), '    remote {', concat('      auth = ', if(auth_method = 'PSK', 'psk', if(auth_method = 'EAP', 'eap-mschapv2', 'pubkey'))), '    }',
      if(rec_ix % 2 = 0, '    children {', '    children\n    {'), '      net {', concat('        mode = ', mode), concat('        esp_proposals = ', CASE pfs_status WHEN 'enabled' THEN 'aes256-sha256-ecp256,aes128-modp2048' WHEN 'disabled' THEN 'aes256-sha256' ELSE 'default' END),
      '      }', '    }', '  }', '}')""",
    "xfrm": """concat_ws('\n', concat('src ', a, ' dst ', b), concat('\tproto esp spi 0x', lpad(lower(hex(rec_ix)), 8, '0'), ' reqid 1 mode ', coalesce(mode, 'tunnel')), '\treplay-window 0',
      concat('src ', b, ' dst ', a), concat('\tproto esp spi 0x', lpad(lower(hex(rec_ix + 1)), 8, '0'), ' reqid 1 mode ', coalesce(mode, 'transport')), if(anti_replay IS NULL, NULL, concat('\treplay-window ', if(anti_replay, 32, 0))))""",
}
A, B = ("'10.' || (rec_ix // 65536) || '.' || (rec_ix // 256 % 256) || '.' || (rec_ix % 256)", "'192.168.0.1'")
ENDS = {"a": A.replace("//", "div"), "b": B}
NONE = "CAST(NULL AS VARCHAR)"
SHOWN = {
    "list-sas": ("local", "remote", "lpad(lower(to_hex(rec_ix)), 16, '0')", "mode", "CASE WHEN mode IS NOT NULL AND pfs_status = 'enabled' THEN 'enabled' END", NONE, "coalesce(version, 'IKEv1')", "CAST(NULL AS BOOLEAN)"),
    "list-conns": ("local", "remote", NONE, "mode", NONE, "auth_method", "coalesce(version, 'IKEv1')", "CAST(NULL AS BOOLEAN)"),
    "conf": ("local", "coalesce(remote, '10.255.0.1')", NONE, "coalesce(mode, 'tunnel')", "pfs_status", "auth_method", "coalesce(version, 'IKEv1')", "CAST(NULL AS BOOLEAN)"),
    "xfrm": (A, B, NONE, "mode", NONE, NONE, NONE, "anti_replay"),
}
NAMES = ("local", "remote", "ike_spi_i", "mode", "pfs_status", "auth_method", "version", "anti_replay")


def gateway_lines(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """The records as text files of one format, read back as lines."""
    records = S.gateway_records(spark, sf_dir).withColumns({k: F.expr(v) for k, v in ENDS.items()})
    path = shared_dir(spark, f"gateway-texts-{uuid.uuid4().hex}")
    records.select(F.expr(TEXTS[form]).alias("value")).write.text(path)
    return O.read_lines(spark, path)


for _form, _shown in SHOWN.items():
    add(
        f"gateway_text_{_form.replace('-', '_')}",
        lambda s, d, form=_form: O.parse_gateway_state(gateway_lines(s, d, form)).select("source", *NAMES),
        f"WITH {GW} SELECT '{_form}' AS source, {', '.join(f'{v} AS {n}' for n, v in zip(NAMES, _shown, strict=True))} FROM gw",
    )
