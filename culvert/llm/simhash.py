"""SimHash near-dedup by balls that meet in the middle.

Two fingerprints within ``radius`` bits share a variant: for an even radius both change up to half of it; for an odd
one the fingerprint of even parity changes one bit more, and those bits all lie in one half of the word (of the
``radius`` bits that differ, one half holds more than half). So each distinct fingerprint emits a fixed number of
variants: 65, and 992 more at even parity, for radius 3. Links are read off without pairs: whoever reaches a
variant is within ``radius`` of whoever reaches it by the smaller ball, so all link to the smallest of those.
A variant has at most 1057 distinct fingerprints around it, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from culvert.llm.common import added, append, arrow_map, free_name, mix, row_uid, table, texts_of
from culvert.llm.components import components
from culvert.session import materialise

SHINGLE, RADIUS, SEED = 3, 3, 42
#: independent fingerprints when documents are to be dropped
PRINTS = 6


def fingerprints(text: bytes, shingle: int = SHINGLE, prints: int = 1) -> np.ndarray:
    """64 majority votes of the XXH64 of each word shingle; 0 without words. Further prints remix the hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(prints, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    hashes = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64)
    out = np.empty(prints, np.uint64)
    for k in range(prints):
        own = mix(hashes, np.full(1, k, np.uint64)) if k else hashes
        votes = np.zeros(64, np.int64)
        for at in range(0, last, 1 << 15):  # bounded memory for very long texts
            votes += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > last, bitorder="little").view("<u8")[0]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], text_at: int, name: str, shingle: int, prints: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprints(t, shingle, prints).view(np.int64) for t in texts_of(batch.column(text_at))]
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        yield append(batch, **{name: pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * prints, pa.int32()), pa.array(flat, pa.int64()))})


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fps", shingle: int = SHINGLE, prints: int = 1) -> DataFrame:
    """Adds the fingerprints as a list of longs (their bits as they are)."""
    return arrow_map(docs, partial(_fingerprints, text_at=docs.columns.index(text_col), name=name, shingle=shingle, prints=prints), added(docs, f"`{name}` array<long>"))


def _masks(bits: range, size: int) -> list[int]:
    out = [sum(1 << b for b in chosen) for chosen in combinations(bits, size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def links_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """salt, a, b: links that join all fingerprints (distinct salt, fp) of a salt within ``radius`` bits, directly or by others."""
    half = radius // 2
    near = [m for size in range(half + 1) for m in _masks(range(64), size)]
    far = _masks(range(32), half + 1) + _masks(range(32, 64), half + 1) if radius % 2 else []
    masks = F.lit(near + far).cast(T.ArrayType(T.LongType(), False))
    # a row grows to hundreds: deal the few columns of fingerprints out evenly first
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def variants(rows: DataFrame, chosen: list[int], first: int) -> DataFrame:
        """salt, key, pos: the fingerprint comes back as key ^ masks[pos], which takes less room than the fingerprint."""
        spread = rows.select("salt", "fp", F.posexplode(F.lit(chosen).cast(T.ArrayType(T.LongType(), False))))
        return spread.select("salt", F.col("fp").bitwiseXOR(F.col("col")).alias("key"), (F.col("pos") + F.lit(first)).cast("short").alias("pos"))

    close, own = variants(prints, near, 0), F.col("key").bitwiseXOR(masks[F.col("pos").cast("int")])
    if far:
        wide = close.union(variants(prints.filter(F.bit_count("fp") % 2 == 0), far, len(near)))
        hubs = close.groupBy("salt", "key").agg(F.min(own).alias("hub"))
        met = wide.join(hubs.hint("shuffle_hash"), ["salt", "key"]).select("salt", "hub", own.alias("fp"))
    else:  # all reach alike; around a key there are at most as many as masks
        met = close.withColumn("fp", own).withColumn("hub", F.min("fp").over(W.partitionBy("salt", "key"))).select("salt", "hub", "fp")
    pairs = met.filter("fp <> hub").select("salt", F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, prints: int) -> DataFrame:
    """id, uid, fps, label (one of each component) for every row. Equal texts are one node of the graph."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_uid(id_col, text_col).alias("uid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(text_col).alias("text"))
    rows = materialise(with_fingerprints(rows, "text", "fps", shingle, prints).select("id", "uid", "node", "fps"), "fingerprints")
    each = rows.select("node", F.posexplode("fps").alias("salt", "fp")).withColumn("salt", F.col("salt").cast("short"))
    first = each.groupBy("salt", "fp").agg(F.min("node").alias("first"))  # one node stands for its fingerprint
    links = links_of(first.select("salt", "fp"), radius)
    between = links.join(first.select("salt", F.col("fp").alias("a"), F.col("first").alias("x")), ["salt", "a"]).join(first.select("salt", F.col("fp").alias("b"), F.col("first").alias("y")), ["salt", "b"])
    same = each.join(first, ["salt", "fp"]).filter("node <> first")
    found = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")).union(same.select("node", "first")))
    return rows.join(found, "node", "left").select("id", "uid", "fps", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fp, component_id (the smallest id of the linked documents) for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words; null and wordless texts have fingerprint 0 and link like others.
    Rows that repeat keep a row each; a null id never names a component unless nothing else is in it. An empty table
    gives an empty result; further columns are ignored.
    """
    rows = materialise(labelled(docs, id_col, text_col, shingle, radius, 1), "labelled")
    # stored, so that the join reads it by an exchange of its own and a large component's rows can be split
    least = materialise(rows.groupBy("label").agg(F.min("id").alias("component_id")), "components")
    return rows.join(least, "label").select("id", F.col("fps")[0].alias("fp"), "component_id")


def first_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the documents of each label (rows: id, uid, label) the one with the smallest id, with its own columns."""
    last, key, uid = F.lit(2**63 - 1), free_name(docs, "__key"), free_name(docs, "__uid")
    chosen = rows.groupBy("label").agg(F.min(F.struct(F.coalesce("id", last).alias("id"), "uid")).alias("s"))
    chosen = chosen.select(F.col("s.id").alias(key), F.col("s.uid").alias(uid))
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), last)).withColumn(uid, row_uid(id_col, text_col))
    return keyed.join(chosen, [key, uid], "left_semi").dropDuplicates([key, uid]).select(docs.columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, prints: int = 1) -> DataFrame:
    """The documents without those linked by fingerprints: of each component the row with the smallest id stays.

    Components are those of ``near_duplicates``; further prints link by any of them. Near fingerprints are no proof of similar
    texts, and most similar texts have distant ones, which ``near_copies`` finds. A null id is the last choice; among rows that share the id a hash of the text decides,
    and exact repeats of a row leave one.
    """
    return first_of_each(docs, labelled(docs, id_col, text_col, shingle, radius, prints), id_col, text_col)


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
