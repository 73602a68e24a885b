"""Machine exports: JSON documents and CEF lines. Rows in, text rows out; files are written by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.operators.flows import NO_ESP
from culvert.plans.skew import attach

CEF_SEVERITY = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 3, "SAFE": 0}  # fixed values


def session_documents(stored: DataFrame, events: DataFrame, fields: Sequence[Column], keys: Sequence[str] = ("job_id", "session_id")) -> DataFrame:
    """JSON documents: one per stored session, and one per anomaly of it, told apart by ``kind``.

    ``stored`` has one row per key. Every anomaly is a document of its own, whatever their number.
    """
    keys = list(keys)
    as_text = {"ignoreNullFields": "false"}
    session = stored.select(*keys, F.lit("session").alias("kind"), F.to_json(F.struct(*fields), as_text).alias("document"))
    entry = F.struct("session_id", "anomaly_id", "anomaly_type", "severity", "description", "t_us")
    own = events.join(stored.select(*keys), keys, "left_semi")
    return session.unionByName(own.select(*keys, F.lit("anomaly").alias("kind"), F.to_json(entry, as_text).alias("document")))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line, one folder per job."""
    documents.select("job_id", F.col("document").alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)


def escape_header(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def escape_extension(value: Column) -> Column:
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    for newline in ("\r\n", "\n", "\r"):
        text = F.replace(text, F.lit(newline), F.lit(" "))
    return text


def _pair(key: str, value: Column) -> Column:
    """``key=value``; NULL or empty values leave the key out."""
    text = value.cast("string")
    return F.when(text != "", F.concat(F.lit(f"{key}="), escape_extension(text)))


def _line(prefix: str, signature: Column, name: Column, severity: Column, extension: list[Column]) -> Column:
    head = F.concat_ws("|", F.lit(prefix), escape_header(signature), escape_header(name), severity.cast("string"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *extension))


def _severity(level: Column) -> Column:
    out = F.when(level == "CRITICAL", CEF_SEVERITY["CRITICAL"])
    for name in ("HIGH", "MEDIUM", "LOW", "SAFE"):
        out = out.when(level == name, CEF_SEVERITY[name])
    return out


def cef_lines(
    assessed: DataFrame, findings: Column, events: DataFrame, vendor: str = "Culvert", product: str = "Tunnel Analytics",
    version: str = "1.0", clean: str = "CLEAN", keys: Sequence[str] = ("job_id", "session_id"),
) -> DataFrame:
    """One line per finding, one per session without findings, one per anomaly."""
    keys = list(keys)
    raw = "|".join(part.replace("\\", "\\\\").replace("|", "\\|") for part in (vendor, product, version))
    prefix = f"CEF:0|{raw}"
    shown = F.when(F.col("traffic.model_version") == NO_ESP, F.lit("")).otherwise(F.col("traffic.predicted_type"))
    when = F.floor(F.col("t_us") / 1000)
    base = [
        _pair("src", F.col("initiator_ip")), _pair("dst", F.col("responder_ip")),
        F.lit("cs1Label=sessionId"), _pair("cs1", F.col("session_id")),
        F.lit("cs2Label=ikeVersion"), _pair("cs2", F.col("ike.version")),
        F.lit("cs3Label=encryption"), _pair("cs3", F.col("ike.encryption")),
        F.lit("cs4Label=dhGroup"), _pair("cs4", F.col("ike.dh_group")),
        F.lit("cn1Label=riskScore"), _pair("cn1", F.col("risk_score")),
        F.lit("cs5Label=trafficType"), _pair("cs5", shown), _pair("rt", when),
    ]
    # the session's own part is put together once, before its findings multiply the rows
    per_session = assessed.select(*keys, F.concat_ws(" ", *base).alias("base"), F.explode_outer(findings).alias("f"))
    extra = [
        F.lit("cs6Label=standard"), _pair("cs6", F.col("f.standard")),
        F.when(F.size("f.inferred_from") > 0, F.lit("flexString1Label=inferredFields")),
        _pair("flexString1", F.array_join("f.inferred_from", ",")), _pair("cve", F.col("f.cve")),
    ]
    line = F.when(
        F.col("f").isNull(), _line(prefix, F.lit(clean), F.lit("No findings"), F.lit(0), [F.col("base")])
    ).otherwise(_line(prefix, F.col("f.rule_id"), F.col("f.description"), _severity(F.col("f.severity")), [F.col("base"), *extra]))
    session_lines = per_session.select(*keys, line.alias("line"))

    ends = assessed.groupBy(*keys).agg(F.max_by(F.struct("initiator_ip", "responder_ip"), "row_no").alias("_ends"))
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = attach(events, counts.join(ends, keys, "left"), keys, "_n")
    event_ext = [
        _pair("src", F.col("_ends.initiator_ip")), _pair("dst", F.col("_ends.responder_ip")),
        F.lit("cs1Label=sessionId"), _pair("cs1", F.col("session_id")),
        F.lit("cs6Label=evidenceFrames"), _pair("cs6", F.col("evidence")), _pair("rt", when),
    ]
    event_lines = placed.select(*keys, _line(prefix, F.col("anomaly_type"), F.col("description"), _severity(F.col("severity")), event_ext).alias("line"))
    return session_lines.unionByName(event_lines)


def write_cef(lines: DataFrame, path: str) -> None:
    lines.select("job_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("job_id").text(path)
