"""Quality rules: base counts of each text, and cross-document line frequency within a host.

A line is normalised (lower case, digits as 0, single spaces) and hashed. The distinct documents of a host that hold
a line are counted; a line above the limit is boilerplate: such lines are cut out of the texts, and a document that loses too many of its
words with them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from culvert.llm.common import LOWER, UPPER, Memo, append, arrow_map, free_name, row_uid, table, texts_of
from culvert.llm.substrings import window_hashes
from culvert.session import materialise

#: a line is above the limit in more documents of a host than this share of them, the limit being between these two counts
LINE_SHARE, LINE_DOCS, LINE_MOST = 0.02, 20, 100
#: a document is depleted when fewer words, or no more than this share of its words, are left
LEFT_WORDS, LEFT_SHARE = 10, 0.3
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"0123456789", b"0000000000")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(words: list[bytes], memo: Memo) -> int:
    """Words in windows of five that occur at least twice."""
    if len(words) <= REPEAT_WINDOW:
        return 0
    hashes = window_hashes(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), REPEAT_WINDOW)
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    step = np.zeros(len(words) + 1, np.int64)
    step[order[twice]] += 1
    step[order[twice] + REPEAT_WINDOW] -= 1
    return int((np.cumsum(step) > 0).sum())


def line_key(words: list[bytes]) -> int:
    """Hash of a line of these words: lower case, digits as 0, single spaces."""
    return xxh64_intdigest(b" ".join(words).lower().translate(DIGITS))


def _facts(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    memo = Memo(xxh64_intdigest)
    is_space, is_symbol = np.zeros(256, bool), np.zeros(256, bool)
    is_space[[*range(9, 14), 32]] = True
    is_symbol[list(SYMBOLS)] = True
    for batch in batches:
        rows: dict[str, list] = {c.split(" ")[0]: [] for c in (BASE + ", lines").split(", ")}
        for text in texts_of(batch.column(text_at)):
            words = text.split()
            raw = np.frombuffer(text, np.uint8)
            seen, again, lines = set(), 0, {}
            for line in text.split(b"\n"):
                own = line.split()
                if own:
                    again += line in seen
                    seen.add(line)
                    key = line_key(own)
                    lines[key] = lines.get(key, 0) + len(own)
            repeats = repeated_words(words, memo)
            rows["n_words"].append(len(words))
            rows["word_chars"].append(int(((raw & 0xC0) != 0x80).sum() - is_space[raw].sum()))
            rows["n_symbols"].append(int(is_symbol[raw].sum()))
            rows["n_dup_lines"].append(again)
            rows["n_repeat_words"].append(repeats)
            rows["base_failed"].append(len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words))
            rows["lines"].append([{"key": k - (1 << 64) if k >= 1 << 63 else k, "words": n} for k, n in lines.items()])
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int64())]))]
        arrays = {k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)}
        yield append(batch.select([n for k, n in enumerate(batch.schema.names) if k != text_at]), **arrays)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, uid, host, the base counts, base_failed, ``cut`` (hashes of the own lines above the limit), lost_words, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_uid(id_col, text_col).alias("uid"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    schema = "id long, uid long, host string, " + BASE + ", lines array<struct<key: long, words: long>>"
    facts = materialise(arrow_map(rows.withColumn("host", F.col("host").cast("string")), partial(_facts, text_at=3), schema), "line-facts")
    once = facts.select("host", "uid", "lines").dropDuplicates(["host", "uid"])
    hosts = materialise(facts.groupBy("host", "uid").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    lines = once.select("host", "uid", F.explode("lines").alias("l")).select("host", "uid", "l.key", "l.words")
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LINE_DOCS)
    h, k = hosts.select(F.col("host").alias("h"), "docs"), free_name(lines, "k")
    limit = F.least(F.greatest(F.col("docs") * F.lit(LINE_SHARE), F.lit(float(LINE_DOCS))), F.lit(float(LINE_MOST)))
    common = counts.join(h, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > limit)
    common = materialise(common.select(F.col("host").alias("h"), F.col("key").alias(k)), "common-lines")
    found = lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col(k)))
    lost = found.groupBy("host", "uid").agg(F.sum("words").alias("lost_words"), F.collect_list("key").alias("cut"))
    lost = lost.select(F.col("host").alias("h"), F.col("uid").alias("u"), "lost_words", "cut")
    joined = facts.drop("lines").join(lost, F.col("host").eqNullSafe(F.col("h")) & (F.col("uid") == F.col("u")), "left").drop("h", "u")
    joined = joined.withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & ((left < LEFT_WORDS) | (left < F.col("n_words") * F.lit(LEFT_SHARE)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, uid, host, the base counts, base_failed, lost_words (in lines above the limit), kept: one row for each row.

    Documents are distinct by id and text: exact repeats of a row count once and get the same result each. A null
    text has no words and fails; a null host is a host, a null id an id. An empty table gives an empty result.
    """
    return _judged(docs, id_col, text_col, host_col).drop("cut")


def _without(batches: Iterator[pa.RecordBatch], text_at: int, cut_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, cut in zip(texts_of(batch.column(text_at)), batch.column(cut_at).to_pylist(), strict=True):
            if cut:
                gone = {k % (1 << 64) for k in cut}
                lines = ((line, line.split()) for line in text.split(b"\n"))
                text = b"\n".join(line for line, own in lines if not own or line_key(own) not in gone)
            texts.append(text)
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == text_at else c for k, c in enumerate(batch.columns) if k != cut_at]
        yield pa.RecordBatch.from_arrays(columns, names=[n for k, n in enumerate(batch.schema.names) if k != cut_at])


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept documents with their own columns, their texts without the lines above the limit.

    Lines are cut whole, with their line end; blank lines stay. A text without such lines is unchanged. Null texts fail,
    so none is left. Rows that repeat stay repeated. An empty table gives an empty result.
    """
    judged = _judged(docs, id_col, text_col, host_col).filter("kept").select("uid", "host", "cut").dropDuplicates(["uid", "host"])
    uid, u, host, cut = (free_name(docs, n) for n in ("__uid", "__u", "__host", "__cut"))
    judged = judged.select(F.col("uid").alias(u), F.col("host").alias(host), F.col("cut").alias(cut))
    own = docs.withColumn(uid, row_uid(id_col, text_col))
    joined = own.join(judged, (F.col(uid) == F.col(u)) & F.col(host_col).cast("string").eqNullSafe(F.col(host))).select(*[F.col(f"`{c}`") for c in docs.columns], cut)
    joined = joined.withColumn(text_col, F.col(text_col).cast("string"))
    return arrow_map(joined, partial(_without, text_at=docs.columns.index(text_col), cut_at=len(docs.columns)), joined.drop(cut).schema)


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("uid", "host")


OP3_SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i : i + 4], ' ')) AS n FROM s),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM w),
d AS (SELECT doc_id, source, line, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM d GROUP BY doc_id),
k AS (SELECT doc_id, source, translate(translate(norm, '{UPPER}', '{LOWER}'), '0123456789', '0000000000') AS norm, len(string_split(norm, ' ')) AS words FROM d),
f AS (SELECT source, norm, count(DISTINCT doc_id) AS n FROM k GROUP BY ALL),
h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
c AS (SELECT f.source, f.norm FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n > least(greatest(docs * {LINE_SHARE}, {LINE_DOCS}), {LINE_MOST})),
x AS (SELECT doc_id, sum(words)::BIGINT AS lost_words FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.norm = c.norm GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN q ON w.doc_id = q.doc_id LEFT JOIN x ON w.doc_id = x.doc_id),
e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT (lost_words > 0 AND (n_words - lost_words < {LEFT_WORDS} OR n_words - lost_words < n_words * {LEFT_SHARE})) AS kept FROM e
"""
