"""Rule evaluation, scoring, compliance, exposure and what-if over sessions.

A session row has an ``ike`` struct (with a ``cert`` struct inside), ``flow`` and ``traffic``.
Rules compile to one boolean column each in a single projection: there is no sessions x rules
join and no shuffle anywhere in this module except the look-up of remediation texts, which is a
broadcast of the fixed rule x vendor table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culvert.functions import ruletables as R
from culvert.functions.numeric import half_even

OPS = ("eq", "in", "gt", "regex", "nonempty")


def check_rules(rules: Sequence[dict] = R.RULES) -> None:
    seen: set[str] = set()
    for r in rules:
        if r["id"] in seen:
            raise ValueError(f"duplicate rule {r['id']}")
        seen.add(r["id"])
        if r["severity"] not in R.PENALTY:
            raise ValueError(f"rule {r['id']} has severity {r['severity']}, which has no penalty")
        for _, op, _ in r["when"]:
            if op not in OPS:
                raise ValueError(f"rule {r['id']} uses unknown operator {op}")


def check_baselines(baselines: Sequence[dict] = R.BASELINES, rules: Sequence[dict] = R.RULES) -> None:
    known = {r["id"] for r in rules}
    for b in baselines:
        missing = sorted(set(b["violated_by"]) - known)
        if missing:
            raise ValueError(f"baseline {b['id']} names unknown rules {missing}")
        for _, op, _, _ in b["requires"]:
            if op not in OPS:
                raise ValueError(f"baseline {b['id']} uses unknown operator {op}")


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type behind a dotted path; None when the schema has no such field."""
    here: T.DataType = schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.fieldNames():
            return None
        here = here[part].dataType
    return F.col(path), here


def clause(schema: T.StructType, path: str, op: str, value) -> Column:
    """One predicate, never NULL: a missing value satisfies nothing."""
    found = resolve(schema, path)
    if found is None:
        return F.lit(op == "nonempty" and not value)
    col, kind = found
    is_bool = isinstance(kind, T.BooleanType)
    if op == "eq":
        if is_bool != isinstance(value, bool):
            return F.lit(False)
        out = col == F.lit(value)
    elif op == "in":
        out = col.isin(*value)
    elif op == "gt":
        out = F.expr(f"try_cast({path} as double)") > F.lit(float(value))
    elif op == "regex":
        out = col.cast("string").rlike(f"(?i){value}")
    elif op == "nonempty":
        if isinstance(kind, (T.ArrayType, T.MapType)):
            full = F.coalesce(F.size(col) > 0, F.lit(False))
        elif isinstance(kind, T.StringType):
            full = F.coalesce(F.length(col) > 0, F.lit(False))
        else:
            full = F.coalesce(col.cast("boolean"), F.lit(False))
        return full if value else ~full
    else:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(out, F.lit(False))


def _at(path: str, ike: str) -> str:
    return ike + path[len("ike") :] if path.startswith("ike.") else path


def conditions(schema: T.StructType, rules: Sequence[dict] = R.RULES, ike: str = "ike") -> dict[str, Column]:
    check_rules(rules)
    return {r["id"]: reduce(lambda a, b: a & b, [clause(schema, _at(p, ike), op, v) for p, op, v in r["when"]]) for r in rules}


def _present(items: Sequence[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def assess(sessions: DataFrame, rules: Sequence[dict] = R.RULES, ike: str = "ike", suffix: str = "") -> DataFrame:
    """Add ``triggered_rules``, ``risk_score`` and ``overall_severity``.

    Advisory rules are listed but neither lower the score nor set the severity.
    """
    named = {f"_{i}{suffix}": c for i, c in conditions(sessions.schema, rules, ike).items()}
    flagged = sessions.withColumns(named)
    fired = {r["id"]: F.col(f"_{r['id']}{suffix}") for r in rules}
    scored = [r for r in rules if not r["advisory"]]
    penalty = reduce(lambda a, b: a + b, [F.when(fired[r["id"]], R.PENALTY[r["severity"]]).otherwise(0) for r in scored], F.lit(0))
    worst = F.lit("SAFE")
    for severity in reversed(R.SEVERITIES[:-1]):
        hits = [fired[r["id"]] for r in scored if r["severity"] == severity]
        if hits:
            worst = F.when(reduce(lambda a, b: a | b, hits), F.lit(severity)).otherwise(worst)
    return flagged.withColumns(
        {
            f"triggered_rules{suffix}": _present([F.when(fired[r["id"]], F.lit(r["id"])) for r in rules]),
            f"risk_score{suffix}": F.greatest(F.lit(0), F.lit(100) - penalty).cast("bigint"),
            f"overall_severity{suffix}": worst,
        }
    ).drop(*named)


def finding_structs(rules: Sequence[dict] = R.RULES, ike: str = "ike") -> Column:
    """Array of findings for the ids in ``triggered_rules``."""
    inferred = F.coalesce(F.col(f"{ike}.inferred_fields"), F.array().cast("array<string>"))
    rows = []
    for r in rules:
        fields = sorted({p.removeprefix("ike.") for p, _, _ in r["when"]})
        rows.append(
            F.when(
                F.array_contains("triggered_rules", r["id"]),
                F.struct(
                    F.lit(r["id"]).alias("rule_id"),
                    F.lit(r["description"]).alias("description"),
                    F.lit(r["severity"]).alias("severity"),
                    F.lit(r["cve"]).cast("string").alias("cve"),
                    F.lit(r["standard"]).alias("standard"),
                    F.array_sort(F.array_intersect(F.array(*[F.lit(f) for f in fields]), inferred)).alias("inferred_from"),
                ),
            )
        )
    return _present(rows)


def findings(assessed: DataFrame, keep: Sequence[str], rules: Sequence[dict] = R.RULES) -> DataFrame:
    """Long table: one row per (session, finding)."""
    kept = [k for k in keep]
    return assessed.select(*kept, F.explode(finding_structs(rules)).alias("f")).select(*kept, "f.*")


def vendor_key(vendor: Column) -> Column:
    name = F.lower(F.coalesce(vendor, F.lit("")))
    out = None
    for needle, key in R.VENDOR_KEYS:
        out = F.when(name.contains(needle), key) if out is None else out.when(name.contains(needle), key)
    return out.otherwise("generic")


def remediation_table(spark: SparkSession, rules: Sequence[dict] = R.RULES) -> DataFrame:
    """Text for every (rule, vendor key): the vendor's own, else generic, else the fallback."""
    texts = R.templates()
    rows = []
    for r in rules:
        group = texts.get(r["group"], {})
        rows += [(r["id"], key, group.get(key) or group.get("generic") or R.FALLBACK) for key in R.TEMPLATE_KEYS]
    return spark.createDataFrame(rows, "rule_id string, vendor_key string, remediation string")


def with_remediation(found: DataFrame, vendor: Column) -> DataFrame:
    table = F.broadcast(remediation_table(found.sparkSession))  # fixed size: rules x vendor keys
    keyed = found.withColumn("vendor_key", vendor_key(vendor))
    return keyed.join(table, ["rule_id", "vendor_key"], "left").withColumn(
        "remediation", F.coalesce("remediation", F.lit(R.FALLBACK))
    )


def threat_entries(found: DataFrame) -> DataFrame:
    """Likelihood and impact of every finding."""

    def grade(i: int) -> Column:
        out = F.when(F.col("severity") == "CRITICAL", R.THREAT_GRADE["CRITICAL"][i])
        for s in ("HIGH", "MEDIUM", "LOW"):
            out = out.when(F.col("severity") == s, R.THREAT_GRADE[s][i])
        return out

    return found.withColumns({"threat": F.col("description"), "likelihood": grade(0), "impact": grade(1)})


def compliance(assessed: DataFrame, keep: Sequence[str], baselines: Sequence[dict] = R.BASELINES) -> DataFrame:
    """Long table: one row per (session, baseline); fail beats not_assessed beats pass."""
    check_baselines(baselines)
    schema = assessed.schema
    rows = []
    for b in baselines:
        bad = [F.when(F.array_contains("triggered_rules", r), F.lit(r)) for r in b["violated_by"]]
        open_items = []
        for path, op, value, label in b["requires"]:
            col = resolve(schema, path)[0]
            hidden = F.coalesce(col == "unknown", F.lit(True))
            open_items.append(F.when(hidden, F.lit(label)))
            bad.append(F.when(~hidden & ~clause(schema, path, op, value), F.lit(f"requires {label}")))
        none = F.array().cast("array<string>")
        rows.append(
            F.struct(
                F.lit(b["id"]).alias("baseline_id"),
                _present(bad).alias("violations"),
                (_present(open_items) if open_items else none).alias("unassessed"),
            )
        )
    long = assessed.select(*keep, F.explode(F.array(*rows)).alias("c")).select(*keep, "c.*")
    status = F.when(F.size("violations") > 0, "fail").when(F.size("unassessed") > 0, "not_assessed").otherwise("pass")
    return long.withColumn("status", status)


EXPOSURE_WEIGHT = {"High": 35, "Med": 20, "Low": 5}  # fixed values
HIGH_CONFIDENCE, MED_CONFIDENCE = 0.8, 0.5


def exposure_structs() -> Column:
    """What an observer learns without breaking encryption, as an array of signals."""

    def signal(name: str, level: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("signal"), level.alias("level"), detail.alias("detail"))

    conf = F.col("traffic.confidence")
    percent = half_even(conf * 100.0).cast("bigint").cast("string")
    active = F.col("flow.pkt_total") > 0
    vague = F.col("traffic.abstained") | (conf < MED_CONFIDENCE)
    traffic = F.when(
        active & (F.col("traffic.predicted_type") != "Other"),
        signal(
            "traffic_type",
            F.when(vague, "Low").when(conf >= HIGH_CONFIDENCE, "High").otherwise("Med"),
            F.when(vague, F.concat(F.lit("best guess only, "), percent, F.lit("%"))).otherwise(
                F.concat(F.col("traffic.predicted_type"), F.lit(" recognisable from packet sizes and timing, "), percent, F.lit("%"))
            ),
        ),
    )
    aggressive = F.coalesce((F.col("ike.version") == "IKEv1") & F.col("ike.aggressive_mode"), F.lit(False))
    subject = F.coalesce(F.col("ike.cert.subject"), F.lit(""))
    identity = F.when(
        aggressive | (subject != ""),
        signal(
            "identity", F.lit("High"),
            F.when(aggressive, "identity sent in the clear by Aggressive Mode").otherwise(F.concat(F.lit("certificate subject readable: "), subject)),
        ),
    )
    implementation = F.when(
        ~F.coalesce("ike.vendor", F.lit("")).isin("", "unknown"),
        signal("implementation", F.lit("Med"), F.concat(F.lit("gateway recognisable as "), F.col("ike.vendor"))),
    )
    endpoints = F.when(
        (F.coalesce("initiator_ip", F.lit("")) != "") & (F.coalesce("responder_ip", F.lit("")) != ""),
        signal("endpoints", F.lit("Low"), F.concat_ws(" ", F.lit("addresses visible:"), "initiator_ip", "responder_ip")),
    )
    tenths = half_even(F.col("flow.rate_pps") * 10.0).cast("bigint")
    timing = F.when(
        active,
        signal(
            "timing", F.lit("Low"),
            F.concat(F.col("flow.pkt_total").cast("string"), F.lit(" packets in "), half_even(F.col("flow.flow_duration_sec")).cast("bigint").cast("string"),
                     F.lit(" s, "), F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("/s")),
        ),
    )
    return _present([traffic, identity, implementation, endpoints, timing])


def exposure(sessions: DataFrame) -> DataFrame:
    """Add ``exposure_signals``, ``exposure_score`` (at most 100) and ``exposure_level``."""
    df = sessions.withColumn("exposure_signals", exposure_structs())

    def level_is(name: str):
        return lambda s: s["level"] == name

    weight = reduce(
        lambda a, b: a + b,
        [F.size(F.filter("exposure_signals", level_is(k))) * F.lit(w) for k, w in EXPOSURE_WEIGHT.items()],
    )
    level = (
        F.when(F.exists("exposure_signals", level_is("High")), "High")
        .when(F.exists("exposure_signals", level_is("Med")), "Med")
        .otherwise("Low")
    )
    return df.withColumns({"exposure_score": F.least(F.lit(100), weight).cast("bigint"), "exposure_level": level})


OVERRIDABLE = ("encryption", "integrity", "dh_group", "pfs_status", "version", "aggressive_mode", "auth_method", "pqc_status")


def simulate(sessions: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score sessions before and after overriding parameters; NULL in an override means keep.

    An overridden field is a hypothesis, so it leaves ``inferred_fields``.
    """
    given = [f for f in OVERRIDABLE if f in overrides.columns]
    named = overrides.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in given])
    j = sessions.join(named, list(keys))
    fields = []
    for f in sessions.schema["ike"].dataType.fieldNames():
        old = F.col(f"ike.{f}")
        if f in given:
            old = F.coalesce(F.col(f"_new_{f}"), old)
        if f == "inferred_fields":
            touched = _present([F.when(F.col(f"_new_{g}").isNotNull(), F.lit(g)) for g in given])
            old = F.array_except(old, touched)
        fields.append(old.alias(f))
    j = j.withColumn("ike_after", F.struct(*fields))
    changed = _present([F.when(F.col(f"_new_{g}").isNotNull() & ~F.col(f"_new_{g}").eqNullSafe(F.col(f"ike.{g}")), F.lit(g)) for g in given])
    j = j.withColumn("changed", changed)
    scored = assess(assess(j, suffix="_before"), ike="ike_after", suffix="_after")
    return scored.select(
        *keys, "changed", "risk_score_before", "risk_score_after", "overall_severity_before", "overall_severity_after",
        F.array_except("triggered_rules_before", "triggered_rules_after").alias("resolved_rules"),
        F.array_except("triggered_rules_after", "triggered_rules_before").alias("new_rules"),
    )


def rule_listing(spark: SparkSession, rules: Sequence[dict] = R.RULES) -> DataFrame:
    rows = [(r["id"], r["severity"], r["description"], r["cve"], r["standard"], r["advisory"]) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, severity string, description string, cve string, standard string, advisory boolean")
