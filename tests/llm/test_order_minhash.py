"""Order MinHash against a plain version, text by text."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest

from culvert.llm import order_minhash as O
from culvert.llm.catalog import QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, key string, hash string, n string, part string, times string, next string"
LONG = " ".join(f"w{k % 37}" for k in range(900))
ROWS = [
    (1, "the cat sat on the mat and the cat slept"), (2, "the mat sat on the cat and the cat slept"), (3, ""), (4, None), (5, "  \n "), (6, "one"), (7, "of the of the of the"),
    (8, "漢字かな交じりの文"), (9, "a b"), (9, "a c"), (None, "no id at all here"), (None, None), (10, LONG), (10, LONG), (10, LONG), (11, LONG + " end"), (-(2**63), "least"), (12, "ab😀cd ef😀"),
]


def signed32(x):
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >= 1 << 31 else x


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain(text):
    """For each point: the next two k-mers round the ring, in the order of the text."""
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("([⺀-꓏豈-﫿\U00020000-\U0003ffff])", r" \1 ", text or "")) if w]
    if not words:
        return [0] * 64
    hashes = [spark_hash(w.encode()) for w in words]
    seen, kmers = Counter(), []
    for at in range(max(1, len(words) - 1)):
        kmer = signed32(spark_hash(*hashes[at : at + 2]))
        kmers.append((signed32(spark_hash(kmer, seen[kmer])), at))
        seen[kmer] += 1
    kmers.sort()
    out = []
    for point in range(64):
        begin = -(1 << 31) + (point << 26)
        first = next((i for i, (h, _) in enumerate(kmers) if h >= begin), 0)
        chosen = sorted(((at, h) for h, at in (kmers[(first + j) % len(kmers)] for j in range(2))))
        out.append(signed32(spark_hash(*(h & 0xFFFFFFFF for _, h in chosen))))
    return out


def wanted(rows, spark):
    """Rows in the order of the ring of next documents."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spark_text_hash(r)))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, its, next_ = plain(text), plain(edited), plain(after)
        share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64
        hexed = lambda a: "".join(f"{x & 0xFFFFFFFF:08x}" for x in a)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(its), share(own, its), share(own, next_)))
    return out


def spark_text_hash(row):
    seed = xxh64_intdigest((row[1] or "").encode(), 42)
    seed = xxh64_intdigest(struct.pack("<i", row[0] is None), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def named(df):
    return [tuple(r) for r in df.select("id", "n_chars", "edited_sha256", O.as_text(F.col("found")), O.as_text(F.col("edited_found")), "near_edited", "near_next").collect()]


def test_equals_plain_version(spark):
    docs = spark.createDataFrame([(*r, *"khnptx") for r in ROWS], SCHEMA).repartition(3)
    got = named(O.compare_with_next(docs))
    assert Counter(got) == Counter(wanted(ROWS, spark))
    by = defaultdict(set)
    for r, f in zip(ROWS, (plain(t) for _, t in ROWS), strict=True):
        by[r[1] or ""].add(tuple(f))
    assert all(len(v) == 1 for v in by.values())
    assert plain(ROWS[0][1]) != plain(ROWS[1][1]), "the same words in another order"
    edited = O.compare_with_next(docs, keep_edited=True)
    assert edited.filter(F.sha2(F.encode("edited", "UTF-8"), 256) != F.col("edited_sha256")).count() == 0
    assert O.compare_with_next(docs.limit(0)).count() == 0
    alone = O.compare_with_next(docs.filter("doc_id = 6")).first()
    assert (alone["near_next"], alone["id"]) == (1.0, 6)


def test_query_equals_plain_version(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_order_minhash"](spark, path).collect()]
    assert Counter(got) == Counter(wanted(rows, spark))
    long = [r for r in got if r[1] > 300]
    assert sum(r[5] > r[6] for r in long) > 0.95 * len(long), "a text is nearer to its edited form than to another document"
