"""Preparing and checking a labelled corpus of captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.operators.flows import list_leaders
from culvert.plans.skew import attach

# The configuration matrix of the corpus.
GRID_MODES = ("tunnel", "transport")
GRID_CIPHERS = ("aes128cbc_sha256", "aes256cbc_sha256", "aes128gcm", "aes256gcm", "3descbc_sha1", "descbc_md5")
GRID_GROUPS = ("modp1024", "modp2048", "ecp256")
GRID_PFS = ("pfs", "nopfs")
GRID_IP = ("ipv4", "ipv6")
CLASSES = ("VoIP", "Video", "Web", "Email", "ICMP", "Chat")
MIN_PACKETS = 20
MIN_CORPUS = 300


def config_grid(
    spark: SparkSession, modes=GRID_MODES, ciphers=GRID_CIPHERS, groups=GRID_GROUPS, pfs=GRID_PFS, ips=GRID_IP
) -> DataFrame:
    """Every configuration with its composed name, by exploding literal dimension lists."""
    df = spark.range(1).select()
    for name, values in (("mode", modes), ("cipher", ciphers), ("dh_group", groups), ("pfs", pfs), ("ip_version", ips)):
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.withColumn("config", F.concat_ws("_", "mode", "cipher", "dh_group", "pfs", "ip_version"))


def stratified_sample(cells: DataFrame, dimensions: Sequence[str], target: int, seed: int, config: str = "config", label: str = "label") -> DataFrame:
    """At least one configuration per (class, dimension value), then random fill up to ``target``.

    "Random" is the order of a seeded MD5, so the sample is the same on any cluster. One minimum
    per stratum and one top-k; no per-stratum sort.
    """

    def order(*parts) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))

    cells = cells.select(config, label, *dimensions).distinct()
    strata = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))
    long = cells.select(config, label, strata.alias("s"))
    picks = long.groupBy(label, "s.dimension", "s.value").agg(
        F.min_by(config, F.struct(order(label, "s.dimension", "s.value", config), config)).alias(config)
    )
    forced = picks.select(config, label).distinct().withColumn("forced", F.lit(True))
    ranked = cells.select(config, label).join(forced, [config, label], "left")
    rank = F.when(F.col("forced"), 0).otherwise(1)
    return ranked.withColumn("forced", F.coalesce("forced", F.lit(False))).orderBy(rank, order(label, config), config, label).limit(target)


def cells_from_labels(labels: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of labels with a known configuration, labels naming an unknown one)."""
    known = configs.select("config").distinct()
    named = labels.withColumn("config", F.get(F.split("name", "__"), 0))
    return named.join(known, "config"), named.join(known, "config", "left_anti")


def remaining_cells(wanted: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def accepted_captures(packets: DataFrame, key: Sequence[str], minimum: int = MIN_PACKETS) -> DataFrame:
    """Captures with enough packets to be a sample."""
    return packets.groupBy(*key).agg(F.count(F.lit(1)).alias("packets")).filter(F.col("packets") >= minimum)


def reconcile_manifest(labels: DataFrame, manifest: DataFrame, key: str = "name") -> DataFrame:
    """Names on one side only."""
    left = labels.select(key).distinct().withColumn("_l", F.lit(True))
    right = manifest.select(key).distinct().withColumn("_m", F.lit(True))
    both = left.join(right, key, "full")
    problem = F.when(F.col("_m").isNull(), "label without manifest entry").when(F.col("_l").isNull(), "manifest entry without label")
    return both.select(key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def class_balance(labels: DataFrame, label: str, classes: Sequence[str] | None = None, minimum: int = MIN_CORPUS) -> DataFrame:
    """Rows per class and the three balance checks (size, all classes, smallest at least half a share)."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    expected = len(classes) if classes else None
    facts = counts.agg(F.sum("rows").alias("total"), F.min("rows").alias("smallest"), F.count(F.lit(1)).alias("classes"))
    share = F.col("total").cast("double") / F.col("classes").cast("double")
    return facts.select(
        "total", "smallest", "classes",
        (F.col("total") >= minimum).alias("big_enough"),
        (F.col("classes") == expected if expected else F.lit(True)).alias("all_classes"),
        (F.col("smallest").cast("double") * 2 >= share).alias("balanced"),
    )


def coverage(labels: DataFrame, dimensions: Sequence[str], label: str, classes: Sequence[str]) -> DataFrame:
    """Rows per (dimension, value) and class, wide; ``other`` counts what is in no class."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))
    long = labels.select(pairs.alias("p"), F.when(F.col(label).isin(*classes), F.col(label)).otherwise("other").alias("_class")).select("p.*", "_class")
    wide = long.groupBy("dimension", "value").pivot("_class", [*classes, "other"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def field_accuracy(parsed: DataFrame, truth: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Share of captures whose parsed value equals the labelled one, per field."""
    j = parsed.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields]).join(truth.select(key, *fields), key)
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"_p_{f}").eqNullSafe(F.col(f)).alias("same")) for f in fields]
    long = j.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.groupBy("field").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if("same").alias("correct"),
        (F.count_if("same").cast("double") / F.count(F.lit(1)).cast("double")).alias("accuracy"),
    )


def first_matches(names: DataFrame, wanted: Sequence[tuple[str, str, str]], name: str = "name", only: str = "") -> DataFrame:
    """First name (in order) per wanted (cipher, group, class): conditional minima in one pass."""
    n = F.col(name)
    usable = names.filter(n.contains(only)) if only else names
    picks = [F.min(F.when(n.contains(c) & n.contains(g) & n.endswith(f"__{k}"), n)).alias(f"p{i}") for i, (c, g, k) in enumerate(wanted)]
    cells = [F.struct(F.lit(i).alias("position"), F.lit("/".join(w)).alias("wanted"), F.col(f"p{i}").alias("picked")) for i, w in enumerate(wanted)]
    return usable.agg(*picks).select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("picked").isNotNull())


def readdress(packets: DataFrame, keys: Sequence[str], left: Column, right: Column) -> DataFrame:
    """Replace the addresses of each session: its first source becomes ``left``, any other ``right``."""
    keys = list(keys)
    counts = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.join(list_leaders(packets, keys), keys)
    j = attach(packets, facts, keys, "_n", "inner").drop("_n")
    return j.withColumns({c: F.when(F.col(c) == F.col("up_src"), left).otherwise(right) for c in ("src", "dst")}).drop("up_src")


# --- label files ---------------------------------------------------------------------------------

# Keys of label files and the values that some may take.
TOP_KEYS = ("pcap", "traffic_class", "substitution", "generator", "duration_sec", "config", "harness_notes", "captured_at", "testbed_commit")
CONFIG_KEYS = ("version", "mode", "encryption", "integrity", "dh_group", "pfs_status", "auth_method", "ip_version", "ike_version")
ALLOWED = {"mode": ("tunnel", "transport"), "pfs_status": ("enabled", "disabled"), "ip_version": ("IPv4", "IPv6"), "version": ("IKEv2",)}
CONFIG_DDL = "struct<" + ",".join(f"{k}:string" for k in CONFIG_KEYS) + ">"
LABEL_DDL = f"pcap string, traffic_class string, substitution boolean, generator string, duration_sec double, config {CONFIG_DDL}, harness_notes array<string>, captured_at string, testbed_commit string"


def stem(path: Column, suffix: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row per label file: ``name``, the raw ``text``, the parsed ``label`` and its key names."""
    raw = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path"), "json").alias("name"), F.col("value").alias("text"))
    return raw.select(
        "name", "text",
        F.from_json("text", LABEL_DDL).alias("label"),
        F.json_object_keys("text").alias("keys"),
        F.json_object_keys(F.get_json_object("text", "$.config")).alias("config_keys"),
    )


def usable_labels(labels: DataFrame, captures: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Labels of a known class that have a capture (``captures`` has ``name``)."""
    return labels.filter(F.col("label.traffic_class").isin(*classes)).join(captures.select("name").distinct(), "name", "left_semi")


def label_errors(labels: DataFrame) -> DataFrame:
    """One row per problem of a label file."""
    name, cls, cfg = F.col("name"), F.col("label.traffic_class"), F.col("label.config")
    keys, ckeys = F.col("keys"), F.coalesce("config_keys", F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(k) for k in sorted(TOP_KEYS)]), keys)
    cmissing = F.array_except(F.array(*[F.lit(k) for k in sorted(CONFIG_KEYS)]), ckeys)
    chat = F.coalesce(cls == "Chat", F.lit(False))
    checks = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ","))),
        F.when(~F.coalesce(F.col("label.pcap") == F.concat(name, F.lit(".pcap")), F.lit(False)), F.lit("capture name differs from file name")),
        F.when(~F.coalesce(cls.isin(*CLASSES), F.lit(False)), F.lit("unknown traffic class")),
        F.when(~name.endswith(F.concat(F.lit("__"), F.lower(F.coalesce(cls, F.lit("none"))))), F.lit("file name does not end in its class")),
        F.when(~F.coalesce(F.col("label.substitution") == chat, F.lit(False)), F.lit("substitution must be set for Chat only")),
        F.when(F.size(cmissing) > 0, F.concat(F.lit("missing config keys: "), F.array_join(cmissing, ","))),
        *[
            F.when(F.array_contains(ckeys, k) & ~F.coalesce(cfg[k].isin(*v), F.lit(False)), F.lit(f"config value not allowed: {k}"))
            for k, v in ALLOWED.items()
        ],
        F.when((F.coalesce(cfg["mode"], F.lit("")) != "") & ~name.startswith(cfg["mode"]), F.lit("file name does not start with its mode")),
    ]
    found = F.when(keys.isNull(), F.array(F.lit("not JSON"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return labels.select("name", F.explode(found).alias("problem"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``digest  name`` lines; comments and blanks skipped, a leading ``*`` of the name dropped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    pattern = r"^\s*(\S+)\s+(.+?)\s*$"
    return lines.select(
        F.regexp_extract("value", pattern, 1).alias("digest"),
        F.regexp_replace(F.regexp_extract("value", pattern, 2), r"^\*+", "").alias("name"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file, hashed where the file is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))


def digest_mismatches(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    listed = manifest.withColumnRenamed("digest", "listed")
    return digests.join(listed, "name").filter(F.col("digest") != F.col("listed")).select("name")


def write_manifest(labels: DataFrame, digests: DataFrame, path: str) -> None:
    """Manifest lines in name order; refuses when a label has no capture."""
    wanted = labels.select(F.concat("name", F.lit(".pcap")).alias("name"))
    missing = wanted.join(digests, "name", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a label has no capture; manifest not written")
    lines = digests.join(wanted, "name", "left_semi").select("name", F.concat_ws("  ", "digest", "name").alias("value"))
    lines.orderBy("name").select("value").write.mode("overwrite").text(path)
