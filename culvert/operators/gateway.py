"""Gateway state: parsing pasted status text and reconciling it with captured sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culvert.functions.net import peer_pair
from culvert.plans.skew import attach, one_row, slice_of
from culvert.session import materialise

VALUE_FIELDS = ("mode", "pfs_status", "auth_method", "version", "anti_replay")
RECORD_FIELDS = ("source", "local", "remote", "ike_spi_i", *VALUE_FIELDS)
FORMATS = ("list-sas", "list-conns", "conf", "xfrm")

# What names a key-exchange group, and the lines that begin a record and show a format.
DH_TOKEN = r"(?i)(modp\d+|ecp\d+|curve\d+|x25519|x448|mlkem\d+|ml_kem|brainpool)"
SAS_HEAD = r"^\S+: #\d+, \w+, (IKEv[12]), ([0-9a-f]{16})_i\*? ([0-9a-f]{16})_r"
CONNS_HEAD = r"^\S+: (IKEv[12])"
CONF_HEAD = r"^\s*remote_addrs\s*="
XFRM_HEAD = r"^src (\S+) dst (\S+)"
HEADS = {"list-sas": SAS_HEAD, "list-conns": CONNS_HEAD, "conf": CONF_HEAD, "xfrm": XFRM_HEAD}
DETECT = {
    "list-sas": r"^\S+: #\d+, \w+, IKEv[12], [0-9a-f]{16}_i",
    "list-conns": r"^\S+: IKEv[12], ",
    "conf": r"^\s*connections\s*\{",
    "xfrm": r"^src \S+ dst \S+\s*$",
}


# --- status text ---------------------------------------------------------------------------------
#
# Texts stay lines: a dump of any size is read in byte ranges. A line belongs to the record whose head is the last one
# before it, so all a line needs to know of the rest of its file is how many heads precede it. That is a running count
# in its range plus the sum over earlier ranges. What a line says is then aggregated by (file, number of the record).


#: lines that are numbered together, and lines of a stored file: what a task sorts is bounded by them
RUN_LINES, FILE_LINES = 1 << 15, 1 << 17


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files: ``path``, byte range ``part``, ``seq`` (rising within a range) and ``line``.

    Files are split by ``spark.sql.files.maxPartitionBytes``; compressed ones are one range each. An empty file has no line.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part")]
    return spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their number ``n`` in the file and, per format, the number of heads up to and with them.

    One row per run of at most ``RUN_LINES`` lines of a byte range is summed over its file; lines are only ordered within a run.
    """
    run = ["path", "part", "run"]
    own = Window.partitionBy(*run).orderBy("seq")
    shown = lines.filter(F.trim(F.translate("line", "\t", " ")) != "").withColumn("run", slice_of(F.col("seq"), RUN_LINES))
    heads = {f"h{i}": F.col("line").rlike(HEADS[f]).cast("long") for i, f in enumerate(FORMATS)}
    marked = shown.withColumns({"n": F.lit(1).cast("long"), **heads})
    counts = ["n", *heads]
    before = Window.partitionBy("path").orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*run).agg(*[F.sum(c).alias(c) for c in counts])
    earlier = totals.select(*run, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    running = marked.select(*run, "line", *[F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in counts])
    return running.join(earlier, run).select("path", "line", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in counts])


def _braces(rows: DataFrame, word: str) -> DataFrame:
    """Lines that open a section: ``word {``, or the word alone and the brace on the next line that is not blank (a comment is not).

    ``rows`` need hold only lines with the word and lines that begin with a brace.
    """
    line = F.rtrim(F.translate("line", "\t", " "))
    same = rows.filter(line.rlike(rf"{word} *\{{"))
    alone = rows.filter(line.endswith(word)).withColumn("n", F.col("n") + 1)
    brace = rows.filter(F.ltrim(line).startswith("{")).select("path", "n").distinct()
    return same.unionByName(alone.join(brace, ["path", "n"], "left_semi"))


def formats_found(numbered: DataFrame) -> DataFrame:
    """``path`` and ``format`` of every format that a file shows; a file may show several."""
    shown = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(f)) for f, p in DETECT.items()]))
    at_line = numbered.select("path", F.explode(shown).alias("format"))
    text = F.trim(F.translate("line", "\t", " "))
    sections = _braces(numbered.filter((text == "connections") | text.startswith("{")), "connections").select("path", F.lit("conf").alias("format"))
    return at_line.unionByName(sections).distinct()


def _words(line: Column) -> Column:
    return F.split(F.trim(F.translate(line, "\t", " ")), " +")


def _after(words: Column, word: str) -> Column:
    """The word behind the first ``word`` of a line."""
    at = F.array_position(words, word)
    return F.when(at > 0, F.get(words, at.cast("int")))


def _address(text: Column) -> Column:
    return F.when(text.rlike("^[0-9a-fA-F:.]+$"), text)


def _last(value: Column) -> Column:
    """Of the lines of a group that say something the last."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("n")))


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("n")))


def _indented(value: Column) -> Column:
    return F.when(F.col("line").rlike("^[ \t]"), value)


def _of_format(numbered: DataFrame, found: DataFrame, form: str) -> DataFrame:
    """Lines of the files that show a format, ``block`` being the number of the record."""
    paths = found.filter(F.col("format") == form).select("path")
    return numbered.join(paths, "path", "left_semi").select("path", "line", "n", F.col(f"h{FORMATS.index(form)}").alias("block"))


def _record(df: DataFrame, form: str, **values: Column) -> DataFrame:
    """Record columns; ``rec_ix`` orders records of a file by format, then by place."""
    none = F.lit(None).cast("string")
    out = {"source": F.lit(form), **values}
    cols = [out.get(f, none if f != "anti_replay" else F.lit(None).cast("boolean")).alias(f) for f in RECORD_FIELDS]
    order = (F.lit(FORMATS.index(form) << 40) + F.col("block")).alias("rec_ix")
    return df.select("path", order, *cols)


def parse_list_sas(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """Established tunnels: SPI and version from the head, the ends, and mode and group of the last child shown as installed."""
    line, words = F.col("line"), _words(F.col("line"))

    def end(side: str) -> Column:
        host = F.substring_index(F.substring_index(line, "' @ ", -1), "[", 1)
        return _indented(F.when((F.get(words, 0) == side) & line.contains("' @ ") & line.contains("["), _address(host)))

    parts = F.split(line, ", ")
    at = F.array_position(parts, "INSTALLED").cast("int")
    suite = F.when((at > 0) & F.get(parts, at + 1).rlike("^(ESP|AH):."), F.get(parts, at + 1))
    mode = F.when(suite.isNotNull(), F.nullif(F.regexp_extract(F.get(parts, at), "^(TUNNEL|TRANSPORT)", 1), F.lit("")))
    version, spi = (F.nullif(F.regexp_extract("line", SAS_HEAD, g), F.lit("")) for g in (1, 2))
    said = _of_format(numbered, found, "list-sas").filter("block > 0").groupBy("path", "block").agg(
        F.max(version).alias("version"), F.max(spi).alias("spi"), _last(end("local")).alias("local"), _last(end("remote")).alias("remote"),
        _last(F.lower(mode)).alias("mode"), F.max(mode.isNotNull() & F.get(F.split(suite, " "), 0).rlike(DH_TOKEN)).alias("keyed"),
    )
    return _record(said, "list-sas", ike_spi_i=F.col("spi"), version=F.col("version"), local=F.col("local"), remote=F.col("remote"), mode=F.col("mode"), pfs_status=F.when(F.col("keyed"), "enabled"))


def parse_list_conns(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """Configured connections: version from the head; ends, how the remote side proves itself, and the mode of the last child."""
    line, words = F.col("line"), _words(F.col("line"))

    def end(side: str) -> Column:
        return _indented(F.when((F.get(words, 0) == side + ":") & (F.size(words) == 2), _address(F.get(words, 1))))

    proof = F.substring_index(line, " authentication:", 1)
    method = F.when(proof.contains("XAuth"), "XAUTH").when(proof.contains("EAP"), "EAP").when(proof.contains("pre-shared key"), "PSK")
    auth = _indented(F.when((F.get(words, 0) == "remote") & line.contains(" authentication:"), method))
    mode = _indented(F.when(F.get(words, 0).endswith(":"), F.nullif(F.regexp_extract(F.get(words, 1), r"^(TUNNEL|TRANSPORT)\b", 1), F.lit(""))))
    said = _of_format(numbered, found, "list-conns").filter("block > 0").groupBy("path", "block").agg(
        F.max(F.nullif(F.regexp_extract("line", CONNS_HEAD, 1), F.lit(""))).alias("version"), _last(end("local")).alias("local"),
        _last(end("remote")).alias("remote"), _last(auth).alias("auth"), _last(F.lower(mode)).alias("mode"),
    )
    return _record(said, "list-conns", version=F.col("version"), local=F.col("local"), remote=F.col("remote"), auth_method=F.col("auth"), mode=F.col("mode"))


def parse_conf(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """One record per ``remote_addrs``; what precedes it since the last one, its head, holds ``local_addrs``.

    The version is the last one of head and record. A line's facts are summed for its own record; those two of the head
    are handed to the next record by its number.
    """
    lines = _of_format(numbered, found, "conf").withColumn("line", F.substring_index("line", "#", 1))
    key, text = F.trim(F.translate(F.substring_index("line", "=", 1), "\t", " ")), F.trim(F.translate("line", "\t", " "))
    stated = text.contains("=")
    value = F.when(stated, F.nullif(F.trim(F.substr(text, F.instr(text, "=") + 1)), F.lit("")))

    def setting(name: str) -> Column:
        return F.when(key == name, value)

    auth, esp = setting("auth"), setting("esp_proposals")
    groups = F.transform(F.split(esp, ","), lambda p: p.rlike(DH_TOKEN))
    facts = lines.groupBy("path", "block").agg(
        _first(setting("remote_addrs")).alias("remote"), _last(setting("local_addrs")).alias("next_local"), _last(setting("version")).alias("version"),
        F.min(auth == "psk").alias("all_psk"), F.max(auth.startswith("eap")).alias("any_eap"), _first(setting("mode")).alias("mode"),
        F.max(esp.contains("default")).alias("any_default"), F.min(F.forall(groups, lambda g: g)).alias("all_groups"), F.max(F.exists(groups, lambda g: g)).alias("any_group"),
    )
    inner = _braces(lines.filter(F.col("line").contains("children") | text.startswith("{")), "children").select("path", "block").distinct()
    facts = facts.join(inner.withColumn("children", F.lit(True)), ["path", "block"], "left")
    heads = facts.select("path", (F.col("block") + 1).alias("block"), F.col("next_local").alias("local"), F.col("version").alias("head_version"))
    said = facts.filter("block > 0").join(heads, ["path", "block"], "left")
    version = F.coalesce("version", "head_version")
    mode = F.when(F.col("mode").isNotNull(), F.when(F.col("mode").startswith("transport"), "transport").otherwise("tunnel")).when(F.col("children"), "tunnel")
    pfs = F.when(~F.col("any_default"), F.when(F.col("all_groups"), "enabled").when(~F.col("any_group"), "disabled"))

    def first_of(name: str) -> Column:
        return F.trim(F.substring_index(name, ",", 1))

    return _record(
        said, "conf", remote=first_of("remote"), local=first_of("local"), mode=mode, pfs_status=pfs,
        version=F.when(version.isNotNull(), F.when(version == "1", "IKEv1").otherwise("IKEv2")), auth_method=F.when(F.col("all_psk"), "PSK").when(F.col("any_eap"), "EAP"),
    )


def parse_xfrm(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """One record per unordered pair: a mode all its entries share, a window if any keeps one."""
    words = _words(F.col("line"))
    sa = _after(words, "proto").isin("esp", "ah") & _after(words, "spi").startswith("0x")
    window = _indented(F.when(F.get(words, 0) == "replay-window", F.regexp_extract(F.get(words, 1), r"^\d+", 0).try_cast("long")))
    ends = F.when(F.col("line").rlike(XFRM_HEAD), F.struct(F.get(words, 1).alias("a"), F.get(words, 3).alias("b")))
    entries = _of_format(numbered, found, "xfrm").filter("block > 0").groupBy("path", "block").agg(
        F.first(ends, ignorenulls=True).alias("ends"), F.min(F.when(sa, _after(words, "mode"))).alias("lo"), F.max(F.when(sa, _after(words, "mode"))).alias("hi"),
        F.count(window).alias("n_windows"), F.max(window).alias("window"),
    )
    pairs = entries.groupBy("path", peer_pair(F.col("ends.a"), F.col("ends.b")).alias("_pair")).agg(
        F.min_by("ends", "block").alias("ends"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("n_windows").alias("n_windows"), F.max("window").alias("window"), F.min("block").alias("block"),
    )
    shared = (F.col("lo") == F.col("hi")) & F.col("lo").isin("tunnel", "transport")
    return _record(
        pairs, "xfrm", local=F.col("ends.a"), remote=F.col("ends.b"),
        mode=F.when(shared, F.col("lo")), anti_replay=F.when(F.col("n_windows") >= 2, F.col("window") > 0),
    )


PARSERS = (parse_list_sas, parse_list_conns, parse_conf, parse_xfrm)


def parse_gateway_state(lines: DataFrame) -> DataFrame:
    """Records of every format found in each file of ``read_lines``; a file may hold several formats. Numbered lines are written once."""
    numbered = materialise(number_lines(lines), "gateway-lines", FILE_LINES)
    found = formats_found(numbered)
    return reduce(lambda a, b: a.unionByName(b), [p(numbered, found) for p in PARSERS])


def unparsed_texts(lines: DataFrame) -> DataFrame:
    """Files in none of the formats: an error for the importer. A file of blank lines is one of them."""
    return lines.select("path").distinct().join(formats_found(number_lines(lines)).select("path").distinct(), "path", "left_anti")


# --- reconcile ---------------------------------------------------------------------------------


def _as_text(field: str) -> Column:
    return F.col(field).cast("string")


def record_facts(records: DataFrame, key: Column) -> DataFrame:
    """Per match key: for every field the first record's value, and all distinct statements.

    Statements are (field, source, value) triples of enumerated values and four source kinds, so
    the set per key is bounded however many records share it.
    """
    keyed = records.withColumn("match_key", key).filter(F.col("match_key").isNotNull())
    # positions restart in every text
    order = F.struct("path", "rec_ix") if "path" in records.columns else F.col("rec_ix")
    firsts = [
        F.min_by(F.struct("rec_ix", _as_text(f).alias("value")), F.when(F.col(f).isNotNull(), order)).alias(f)
        for f in VALUE_FIELDS
    ]
    said = F.filter(
        F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), "source", _as_text(f).alias("value"))) for f in VALUE_FIELDS]),
        lambda x: x.isNotNull(),
    )
    base = keyed.groupBy("match_key").agg(*firsts, F.count(F.lit(1)).alias("records"))
    stated = keyed.select("match_key", F.explode(said).alias("s")).distinct().groupBy("match_key").agg(F.collect_set("s").alias("said"))
    return base.join(stated, "match_key", "left")


def spi_of(session_id: Column) -> Column:
    return F.substring(F.lower(session_id), 1, 16)


def _drift_notes(said: Column, field: str, wire: Column) -> Column:
    """One note per gateway statement about ``field`` that differs from what the wire showed."""
    other = F.filter(said, lambda x: (x["field"] == field) & (x["value"] != wire))
    return F.transform(other, lambda x: F.concat(F.lit(f"{field}: wire "), wire, F.lit(", "), x["source"], F.lit(" "), x["value"]))


def reconcile(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Attach gateway values to sessions.

    Matching by SPI or by unordered peers is two look-ups of per-key facts; no (session, record)
    pairs are formed, so a pair with many sessions and many records costs their sum. Adds per
    field the resulting value (``new_<field>``), ``filled`` fields, and ``mismatches`` notes.
    """
    pair = peer_pair(F.col("initiator_ip"), F.col("responder_ip"))
    s = sessions.withColumns({"_spi": spi_of(F.col("session_id")), "_pair": pair})
    by_spi = record_facts(records, F.col("ike_spi_i"))
    by_pair = record_facts(records, F.when(F.col("local").isNotNull() | F.col("remote").isNotNull(), peer_pair(F.col("local"), F.col("remote"))))

    def look_up(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
        counts = s.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))  # from the source: the look-ups keep every row
        packed = facts.select(F.col("match_key").alias(key), F.struct(*VALUE_FIELDS, "said").alias(f"{key}_f"))
        return attach(rows, counts.join(packed, key, "left"), [key], "_n").drop("_n")

    j = look_up(look_up(s, "_spi", by_spi), "_pair", by_pair)
    filled, notes, new = [], [], {}
    said = F.array_union(
        F.coalesce(F.col("_spi_f.said"), F.array().cast("array<struct<field:string,source:string,value:string>>")),
        F.coalesce(F.col("_pair_f.said"), F.array().cast("array<struct<field:string,source:string,value:string>>")),
    )
    for f in VALUE_FIELDS:
        a, b = F.col(f"_spi_f.{f}"), F.col(f"_pair_f.{f}")
        best = F.when(b["rec_ix"].isNull() | (a["rec_ix"] <= b["rec_ix"]), a).otherwise(b)
        wire = F.col(f"ike.{f}").cast("string")
        hidden = wire.isNull() | (wire == "unknown") | F.array_contains("ike.inferred_fields", f)
        value = best["value"]
        take = hidden & value.isNotNull()
        new[f"new_{f}"] = F.when(take, value).otherwise(wire)
        filled.append(F.when(take & ~F.array_contains("ike.gateway_fields", f), F.lit(f)))
        differs = ~hidden & ~F.array_contains("ike.gateway_fields", f)
        notes.append(F.when(differs, _drift_notes(said, f, wire)).otherwise(F.array().cast("array<string>")))
    present = F.filter(F.array(*filled), lambda x: x.isNotNull())
    matched = F.col("_spi_f").isNotNull() | F.col("_pair_f").isNotNull()
    return j.withColumns(
        {**new, "filled": present, "mismatches": F.array_sort(F.array_distinct(F.flatten(F.array(*notes)))), "matched": matched}
    ).drop("_spi", "_pair", "_spi_f", "_pair_f")


def apply_to_sessions(reconciled: DataFrame) -> DataFrame:
    """Write reconciled values into ``ike``: values, provenance and drift notes (for re-scoring)."""
    kinds = {f.name: f.dataType for f in reconciled.schema["ike"].dataType.fields}
    fields = []
    for name, kind in kinds.items():
        old = F.col(f"ike.{name}")
        if name in VALUE_FIELDS:
            old = F.col(f"new_{name}").cast(kind)
        elif name == "inferred_fields":
            took = F.filter(F.array(*[F.when(~F.col(f"new_{f}").eqNullSafe(F.col(f"ike.{f}").cast("string")), F.lit(f)) for f in VALUE_FIELDS]), lambda x: x.isNotNull())
            old = F.array_except(F.array_except(old, "filled"), took)
        elif name == "mode_confidence":  # a stated mode is no guess
            old = F.when(~F.array_contains("filled", "mode"), old)
        elif name == "gateway_fields":
            old = F.array_union(old, "filled")
        elif name == "gateway_mismatches":
            old = F.array_union(old, "mismatches")
        fields.append(old.alias(name))
    extra = [f"new_{f}" for f in VALUE_FIELDS] + ["filled", "mismatches", "matched"]
    return reconciled.withColumn("ike", F.struct(*fields)).drop(*extra)


def filled_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.select(F.explode("filled").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("sessions"))


def unmatched_records(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Records no session answers to, by two anti joins on distinct keys."""
    spis = sessions.select(spi_of(F.col("session_id")).alias("ike_spi_i")).distinct()
    pairs = sessions.select(peer_pair(F.col("initiator_ip"), F.col("responder_ip")).alias("_pair")).distinct()
    keyed = records.withColumn("_pair", F.when(F.col("local").isNotNull() | F.col("remote").isNotNull(), peer_pair(F.col("local"), F.col("remote"))))
    return keyed.join(spis, "ike_spi_i", "left_anti").join(pairs, "_pair", "left_anti").drop("_pair")


def import_summary(sessions: DataFrame, records: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row: records, matched sessions, filled fields, mismatch notes, unmatched records."""
    a = reconciled.filter("matched").groupBy("session_id").agg(
        F.sum(F.size("filled")).alias("_f"), F.sum(F.size("mismatches")).alias("_m")
    ).agg(F.count(F.lit(1)).alias("matched_sessions"), F.coalesce(F.sum("_f"), F.lit(0)).alias("filled"), F.coalesce(F.sum("_m"), F.lit(0)).alias("mismatches"))
    r = records.agg(F.count(F.lit(1)).alias("records"))
    u = unmatched_records(sessions, records).agg(F.count(F.lit(1)).alias("unmatched_records"))
    return one_row(r, a, u)
