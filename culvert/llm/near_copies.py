"""Near copies by verified similarity: texts that share at least 0.8 of their distinct five-word shingles.

SimHash cannot give the candidates: texts that share 0.8 of their shingles differ in some ten of 64 bits, far outside any ball
that can be listed. So ``BANDS`` keys of ``ROWS`` minima each do: two texts share a key with probability
1 - (1 - s ** ROWS) ** BANDS, over 0.9999 at s = 0.8. A shared key links nothing by itself: the exact Jaccard similarity of
both shingle sets decides (equal shingles are equal 64-bit hashes).

Pairs stay few: all texts of a key are first compared with its smallest one. Where a key still has texts of several components, its
first ``HUBS`` texts by a hash of the text alone are compared with all that are not in their component yet; so texts that
share many keys meet the same hubs in each of them, and a pair is compared once. Such rounds go on, each with more hubs, until the
texts of each key that have not been hubs lie in one component: then no pair of any key is left that could join two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from culvert.llm.common import arrow_map, mix, row_uid, texts_of
from culvert.llm.components import components
from culvert.llm.simhash import first_of_each
from culvert.session import materialise

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS, SEED = 20, 4, 42
#: hubs of a key in the first round, and how many times more in each further one
HUBS, MORE = 16, 4
CHUNK = 4096
FACTORS = mix(np.arange(BANDS * ROWS, dtype=np.uint64), np.full(1, SEED, np.uint64)) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, also one without words."""
    own = text.lower().split()
    line = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(own) - words + 1]
    return np.unique(np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of minima of remixed hashes."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):  # bounded memory for very long texts
        np.minimum(least, (FACTORS[:, None] * found[None, at : at + CHUNK]).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key, least[:, k])
    return key


def _keys(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t, words) for t in texts_of(batch.column("text"))]
        found = [band_keys(s).view(np.int64) for s in sets]
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))
        size = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "uid", "node")), keys, size], names=["id", "uid", "node", "keys", "size"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t, words).tobytes() for t in texts_of(batch.column("text"))], pa.binary())], names=["node", "set"])


def _verified(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similar * max(len(x), len(y)) else 0
            ok.append(shared / (len(x) + len(y) - shared) >= similar)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return materialise(arrow_map(both, partial(_verified, similar=similar), "a long, b long"), "near-links")


def labelled(docs: DataFrame, id_col: str, text_col: str, words: int, similar: float, hubs: int = HUBS) -> DataFrame:
    """id, uid, label (one of each component) for every row. Equal texts are one node of the graph."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), row_uid(id_col, text_col).alias("uid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(text_col).alias("text"))
    rows = materialise(arrow_map(texts, partial(_keys, words=words), "id long, uid long, node long, keys array<long>, size long"), "near-keys")
    each = rows.select("node", "size", F.explode("keys").alias("key")).distinct()
    shared = each.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.min_by("size", "node").alias("its_size")).filter("hub <> top").drop("top")
    members = materialise(each.join(shared, "key").filter("node <> hub"), "near-members")
    alike = F.least("size", "its_size") >= F.greatest("size", "its_size") * F.lit(similar - 1e-9)  # else too unlike in size
    compared = members.filter(alike).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    needed = members.select("node").union(members.select("hub")).distinct()
    sets = materialise(arrow_map(texts.select("node", "text").join(needed, "node", "left_semi").dropDuplicates(["node"]), partial(_sets, words=words), "node long, set binary"), "near-sets")
    links, members = verified(compared, sets, similar), members.select("key", "node", "size")
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    while True:
        found = components(links)
        members = members.join(found, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
        split = members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("key")
        members = materialise(members.join(split, "key", "left_semi"), "near-rest")
        if members.isEmpty():
            break
        nth = F.row_number().over(W.partitionBy("key").orderBy(order))
        chosen = members.withColumn("nth", nth).filter(F.col("nth") <= hubs).select("key", F.col("node").alias("other"), F.col("label").alias("its"), F.col("size").alias("its_size"), order.alias("o"))
        met = members.join(chosen, "key").filter(F.col("label") != F.col("its")).filter(alike)
        more = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        more = materialise(more.join(compared, ["a", "b"], "left_anti"), "near-pairs")
        links, compared = links.union(verified(more, sets, similar)), compared.union(more)
        # who has been a hub has met all others
        last = chosen.groupBy("key").agg(F.max("o").alias("last"))
        members, hubs = members.join(last, "key").filter(order > F.col("last")).select("key", "node", "size"), hubs * MORE
    return rows.select("id", "uid", "node").join(found, "node", "left").select("id", "uid", F.coalesce("label", "node").alias("label"))


def one_of_each_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """The documents without near copies: of each group joined by similar pairs the row with the smallest id stays.

    Texts are lower-cased (A-Z) and cut into words; null and wordless texts are similar to each other. A null id is the
    last choice; among rows that share the id a hash of the text decides, and exact repeats of a row leave one. An empty
    table gives an empty result.
    """
    return first_of_each(docs, labelled(docs, id_col, text_col, words, similar), id_col, text_col)
