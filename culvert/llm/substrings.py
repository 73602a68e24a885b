"""Substring dedup: Rabin-Karp hashes of every window of 20 words, counted in Spark.

Each task hashes the windows of a batch of documents in one vectorised pass. Per batch only the first occurrence of
a hash leaves the task, packed into one row per hash range, so a passage that a third of all documents hold reaches
a range once per batch. Each hash range finds the smallest (doc_id, start) of every hash; all other occurrences go
back to their documents, where overlapping and adjacent windows merge into maximal removal intervals.

Windows are equal when their 64-bit hashes are equal: among N windows about N * N / 2**65 pairs collide by chance.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from culvert.llm.common import NULL_ID, Memo, added, append, arrow_map, free_name, prepare, row_uid, table, texts_of

WINDOW = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: a task packs the windows of about this many bytes of text at a time
PACK_BYTES = 8 << 20
#: one hash range holds the windows of about this many bytes of text
RANGE_BYTES = 16 << 20
PACKED = "part long, hashes binary, starts binary, ids binary, uids binary, bases binary"
FOUND = "slot long, ids array<long>, uids array<long>, starts array<int>"
MERGED = "id long, uid long, starts array<int>"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of ``width`` values, by doubling, then mixed for even ranges."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    total = len(words) - width + 1
    out, covered = np.zeros(total, np.uint64), 0
    run, size, power = words, 1, BASE
    with np.errstate(over="ignore"):
        while True:
            if width & size:  # append the next ``size`` values at the position covered so far
                out = out * power + run[covered : covered + total]
                covered += size
            if covered == width:
                break
            run = run[:-size] * power + run[size:]
            size, power = size * 2, power * power
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array by significance: high bytes that are all zero compress to nothing in the shuffle."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _pack(docs: list[tuple[int, int, np.ndarray]], width: int, parts: int) -> Iterator[dict]:
    """Rows for each hash range, and one row with the occurrences that repeat inside this batch."""
    docs = [d for d in sorted({d[:2]: d for d in docs}.values(), key=lambda d: d[:2]) if len(d[2]) >= width]
    if not docs:
        return
    counts = np.array([len(d[2]) for d in docs])
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    hashes = window_hashes(np.concatenate([d[2] for d in docs]), width)
    inside = np.ones(len(hashes), bool)
    for end in begins[1:]:
        inside[end - width + 1 : end] = False
    hashes = hashes[inside]
    bases = (begins - np.arange(len(docs)) * (width - 1)).astype(np.int64)  # the first window of each document
    ids, uids = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
    order = np.argsort(hashes)
    ranked = hashes[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    first = np.minimum.reduceat(order, heads)
    repeats = np.ones(len(hashes), bool)
    repeats[first] = False
    again = np.flatnonzero(repeats)
    if len(again):
        yield _row(-1 - int(uids[0]) % parts, b"", again, ids, uids, bases)
    keys = ranked[heads]
    cuts = np.searchsorted(keys, np.array([((k << 64) + parts - 1) // parts for k in range(1, parts)], np.uint64))
    for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        if lo < hi:
            yield _row(part, planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), first[lo:hi], ids, uids, bases)


def _row(part: int, hashes: bytes, at: np.ndarray, ids: np.ndarray, uids: np.ndarray, bases: np.ndarray) -> dict:
    """Positions as offsets among the documents that occur in this row."""
    doc = np.searchsorted(bases, at, "right") - 1
    used, slot = np.unique(doc, return_inverse=True)
    sizes = np.append(bases[1:], bases[-1] + (1 << 31))[used] - bases[used]
    sizes[-1] = (at - bases[doc]).max() + 1
    own = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    starts = (own[slot] + at - bases[doc]).astype(np.uint32)
    return {"part": part, "hashes": hashes, "starts": planes(starts), "ids": planes(np.diff(ids[used], prepend=0)), "uids": uids[used].tobytes(), "bases": planes(np.diff(own.astype(np.uint32), prepend=np.uint32(0)))}


def _packed(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"part": pa.int64(), "hashes": pa.binary(), "starts": pa.binary(), "ids": pa.binary(), "uids": pa.binary(), "bases": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def _pack_batches(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    memo, docs, size = Memo(xxh64_intdigest), [], 0
    for batch in batches:
        for i, u, text in zip(batch["id"].to_pylist(), batch["uid"].to_pylist(), texts_of(batch["text"]), strict=True):
            words = text.split()
            docs.append((i, u, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))))
            size += len(text)
            if size >= PACK_BYTES:
                if rows := list(_pack(docs, width, parts)):
                    yield _packed(rows)
                docs, size = [], 0
    if rows := list(_pack(docs, width, parts)):
        yield _packed(rows)


def _lists(heads: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)), pa.int32()), pa.array(values, kind))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))


def _by_slot(ids: np.ndarray, uids: np.ndarray, starts: np.ndarray, parts: int) -> pa.Table:
    """One row for each slot of documents, so that the rows of a range don't multiply with the documents."""
    order = np.lexsort((starts, uids, ids, uids % parts))
    ids, uids, starts = ids[order], uids[order], starts[order]
    heads = _heads(uids % parts)
    return pa.table({"slot": pa.array(uids[heads] % parts), "ids": _lists(heads, ids, pa.int64()), "uids": _lists(heads, uids, pa.int64()), "starts": _lists(heads, starts, pa.int32())})


def _by_document(group: pa.Table) -> pa.Table:
    ids, uids, starts = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "uids", "starts"))
    order = np.lexsort((starts, uids, ids))
    ids, uids, starts = ids[order], uids[order], starts[order]
    heads = _heads(ids, uids)
    return pa.table({"id": pa.array(ids[heads]), "uid": pa.array(uids[heads]), "starts": _lists(heads, starts, pa.int32())})


def _find(group: pa.Table, parts: int) -> pa.Table:
    """Of one hash range: every occurrence behind the first of its hash."""
    slot, hashes, at, ids, uids, bases, offset = [], [], [], [], [], [], 0
    for r in group.to_pylist():
        starts = unplanes(r["starts"], np.uint32).astype(np.int64)
        own = np.cumsum(unplanes(r["bases"], np.uint32), dtype=np.int64)
        doc = np.searchsorted(own, starts, "right") - 1
        slot.append(doc + offset)
        at.append(starts - own[doc])
        offset += len(own)
        ids.append(np.cumsum(unplanes(r["ids"], np.int64)))
        uids.append(np.frombuffer(r["uids"], np.int64))
        hashes.append(np.cumsum(unplanes(r["hashes"], np.uint64), dtype=np.uint64) if r["hashes"] else np.empty(0, np.uint64))
    slot, at, ids, uids, hashes = (np.concatenate(x) for x in (slot, at, ids, uids, hashes))
    if not len(hashes):  # occurrences that repeat inside a batch
        return _by_slot(ids[slot], uids[slot], at, parts)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]  # hashes of two or more batches
    i, u, s, h = ids[slot[order]], uids[slot[order]], at[order], hashes[order]
    order = np.lexsort((s, u, i, h))
    i, u, s, h = i[order], u[order], s[order], h[order]
    head = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    later = (i != i[lead]) | (u != u[lead]) | (s != s[lead])
    return _by_slot(i[later], u[later], s[later], parts)


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words [begin, end) that windows starting at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    breaks = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.append(breaks, len(starts) - 1)] + width).tolist(), strict=True))


def without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """The text without the words of some intervals and the space before each of them."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for begin, end in cut:
        out.append(text[at : spans[begin - 1][1] if begin else 0])
        at = spans[end - 1][1]
    out.append(text[at:])
    return b"".join(out).lstrip() if cut[0][0] == 0 else b"".join(out)


def _remove(batches: Iterator[pa.RecordBatch], width: int, text_at: int, starts_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, total, removed, digest = texts_of(batch.column(text_at)), [], [], [], []
        for text, raw, starts in zip(texts, batch.column(text_at).is_null().to_pylist(), batch.column(starts_at).to_pylist(), strict=True):
            words = text.split()
            cut = intervals(np.array(starts or [], np.int64), width)
            total.append(len(words))
            removed.append(sum(e - b for b, e in cut))
            if cut:
                mask = np.ones(len(words), bool)
                for b, e in cut:
                    mask[b:e] = False
                words = [words[k] for k in np.flatnonzero(mask)]
                text = without(text, cut)
            kept.append(None if raw else text)
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        columns, names = list(batch.columns), list(batch.schema.names)
        columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
        columns[starts_at : starts_at + 1] = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        names[starts_at : starts_at + 1] = ["n_words", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """id, uid, starts: of each document the starts of windows whose words also start earlier."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), row_uid(id_col, text_col).alias("uid"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / RANGE_BYTES))
    packed = arrow_map(rows, partial(_pack_batches, width=width, parts=parts), PACKED)
    prepare(docs.sparkSession)

    def find(group: pa.Table) -> pa.Table:
        return _find(group, parts)

    found = packed.groupBy("part").applyInArrow(find, FOUND)
    return found.groupBy("slot").applyInArrow(_by_document, MERGED)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """The documents without words covered by a window of ``width`` words that also starts earlier, and what was done.

    Earlier means a smaller id (null before all), or the same id at an earlier start. Adds n_words, n_removed and
    kept_sha256 (the kept words joined by one space). Texts that lose nothing stay as they are; others lose whole
    words and keep the white space between what is left. A null text counts as empty and stays null. Rows that share
    id and text are one document: each row gets its result. Rows that share an id with different texts are ordered
    by a hash of the text. An empty table gives an empty result; columns of the same names as the added ones are
    replaced.
    """
    base = docs.drop("n_words", "n_removed", "kept_sha256")
    id_key, uid_key, starts_key = (free_name(base, n) for n in ("__id", "__uid", "__starts"))
    found = repeated_windows(docs, id_col, text_col, width).select(F.col("id").alias(id_key), F.col("uid").alias(uid_key), F.col("starts").alias(starts_key))
    keyed = base.withColumn(id_key, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(uid_key, row_uid(id_col, text_col))
    joined = keyed.join(found, [id_key, uid_key], "left").select(*[F.col(f"`{c}`") for c in base.columns], starts_key)
    at = base.columns.index(text_col)
    schema = added(base, "n_words long, n_removed long, kept_sha256 string")
    return arrow_map(joined, partial(_remove, width=width, text_at=at, starts_at=len(base.columns)), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS k FROM s JOIN w USING (doc_id)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT p.doc_id, p.word, p.j, c.j IS NULL AS keep FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.j = c.j)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(count(*) FILTER (NOT k.keep), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.j) FILTER (k.keep), '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id GROUP BY w.doc_id, w.ws
"""
