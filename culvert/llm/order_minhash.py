"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers are runs of ``K`` words, each numbered among its equals (the second "of the" is another k-mer than the
first). A k-mer hashes to 32 bits; ``POINTS`` orders of all k-mers are the rotations of that ring of hashes, so one sort
serves all of them: the minimal k-mers of an order are the next ones behind its point, round the ring. Of each order the ``TUPLE``
minimal k-mers, put into the order of the text, are hashed together. Two texts agree in a signature if they share these k-mers *and*
have them in the same order; the share of equal signatures falls with the edit distance, not only with the shared words.

Scripts written without spaces count each character as a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.llm.common import NULL_ID, table
from culvert.session import materialise

K, TUPLE, BITS = 2, 2, 6
POINTS = 1 << BITS
#: characters of scripts without spaces
WIDE = r"([\x{2E80}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])"
#: signature of a text without words
NOTHING = 0
LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def packed(high: Column, low: Column) -> Column:
    """32 bits above 32 bits; sorts by the first as a signed number, then by the second."""
    return F.shiftleft(high, 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(LOW)))


def high(x: Column) -> Column:
    return F.shiftright(x, 32)


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _numbered(kmers: Column) -> Column:
    """Sorted (hash, place) of k-mers to sorted (hash with its number among equals, place)."""
    begins = F.filter(F.sequence(F.lit(0), F.size(kmers) - 1), lambda i: (i == 0) | (high(F.get(kmers, i)) != high(F.get(kmers, i - 1))))
    numbers = let(begins, lambda b: F.flatten(F.transform(b, lambda start, run: F.sequence(F.lit(0), F.coalesce(F.get(b, run + 1), F.size(kmers)) - start - 1))))
    return let(numbers, lambda n: F.sort_array(F.transform(kmers, lambda x, i: packed(F.xxhash64(high(x), F.get(n, i).cast("long")), low(x)))))


def _arc(x: Column) -> Column:
    """Which of the ring's arcs, each beginning at a point, a k-mer lies in."""
    return (F.shiftright(x, 64 - BITS) + F.lit(POINTS // 2)).cast("int")


def _signatures(ring: Column) -> Column:
    """Signatures of all points, from the ``TUPLE`` first k-mers of each arc."""

    def signature(i: Column) -> Column:
        chosen = F.transform(F.sequence(F.lit(0), F.lit(TUPLE - 1)), lambda j: let(F.get(ring, ((i + j) % F.size(ring)).cast("int")), lambda x: packed(low(x), high(x))))
        return let(F.sort_array(chosen), lambda t: high(F.shiftleft(F.xxhash64(*(low(F.get(t, F.lit(j))) for j in range(TUPLE))), 32)).cast("int"))

    def points(x: Column, i: Column) -> Column:
        """How many points have this k-mer as their first: those behind the arc of the k-mer before it."""
        return _arc(x) - F.coalesce(_arc(F.get(ring, i - 1)), F.lit(-1))

    none = F.array().cast("array<int>")
    through = F.flatten(F.transform(ring, lambda x, i: let(points(x, i), lambda n: F.when(n > 0, F.array_repeat(signature(i), n)).otherwise(none))))
    return F.concat(through, F.array_repeat(signature(F.lit(0)), F.lit(POINTS - 1) - _arc(F.element_at(ring, -1))))


def signatures(text: Column) -> Column:
    """The ``POINTS`` signatures of a text as ints; a text of fewer than ``K`` words is one k-mer, one without words has none."""
    words = F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), WIDE, " $1 "), r"[\x20\x09-\x0D]+"), "")

    def kmers(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (K - 1), F.lit(1)))
        return F.sort_array(F.transform(starts, lambda x, i: packed(F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, K))), i)))

    ring = lambda sorted_: F.filter(sorted_, lambda x, i: (i < TUPLE) | (_arc(F.get(sorted_, i - TUPLE)) != _arc(x)))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 0, let(let(let(kmers(h), _numbered), ring), _signatures)))
    return F.coalesce(found, F.array_repeat(F.lit(NOTHING), POINTS))


def likeness(one: Column, other: Column) -> Column:
    """The share of equal signatures."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), F.lit(0), lambda n, i: n + (F.get(one, i) == F.get(other, i)).cast("int")) / F.lit(float(POINTS))


def as_text(found: Column) -> Column:
    """Signatures as eight hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(LOW)))), 8, "0")), "")


def fingerprint(text: Column) -> Column:
    return as_text(signatures(text))


def _in_order(groups: DataFrame) -> DataFrame:
    """key, hash, absent, n, times and (next_key, next_hash) of the next text by descending id, round from the last to the first.

    Ranges of a sort are read each by itself; the last text of a range takes the first one of the next range from a table with
    a row for each range.
    """
    order = [F.col("key").desc(), F.col("absent"), F.col("hash")]
    placed = materialise(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "text-order")
    own = W.partitionBy("part").orderBy(*order)
    inner = placed.withColumn("next", F.lead(F.struct("key", "hash")).over(own))
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.bitwise_not("key").alias("o"), "absent", "hash", "key")).alias("f"))
    ring = firsts.groupBy().agg(F.sort_array(F.collect_list(F.struct("part", F.struct("f.key", "f.hash").alias("f")))).alias("all"))
    after = ring.select(F.posexplode("all").alias("at", "x"), "all").select(F.col("x.part").alias("part"), F.get("all", (F.col("at") + 1) % F.size("all"))["f"].alias("across"))
    joined = inner.join(F.broadcast(after), "part").withColumn("next", F.coalesce("next", "across"))
    return joined.select("key", "hash", "absent", "n", "times", F.col("next.key").alias("next_key"), F.col("next.hash").alias("next_hash"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_edited: bool = False) -> DataFrame:
    """id, n_chars, edited_sha256, found, edited_found, near_edited, near_next (and edited) for every row of ``docs``.

    ``edited`` is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's by descending id; the next of the last is the first. ``found`` and ``edited_found`` are the signatures of
    the text and of ``edited``; near_edited and near_next compare the text with ``edited`` and with the next document.

    A null text is empty; null ids come last. Rows that share an id follow each other by a hash of their text; each of several
    equal rows is the next of the one before. A single row is its own next. An empty table gives an empty result;
    further columns are ignored.
    """
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(text_col), F.lit(""))
    absent = F.col(id_col).isNull()
    rows = docs.select(key.alias("key"), F.xxhash64(text, absent).alias("hash"), absent.alias("absent"), text.alias("text"))
    groups = rows.select("key", "hash", "absent", F.length("text").alias("n")).groupBy("key", "absent", "hash", "n").agg(F.count("*").alias("times"))
    chain = materialise(_in_order(groups), "text-chain")
    texts = rows.groupBy("key", "hash").agg(F.first("text").alias("text"))  # the same exchange serves both joins
    # the beginning of each text goes to the one before it
    before = chain.select(F.col("next_key").alias("key"), F.col("next_hash").alias("hash"), F.col("key").alias("k"), F.col("hash").alias("h"), F.floor(F.col("n") / 3).cast("int").alias("third"))
    patches = texts.join(before, ["key", "hash"]).select(F.col("k").alias("key"), F.col("h").alias("hash"), F.left("text", F.col("third")).alias("patch"))
    whole = texts.join(chain, ["key", "hash"]).join(patches, ["key", "hash"])
    third = F.floor(F.col("n") / 3).cast("int")
    onward = F.struct("patch", F.lit(1).cast("long").alias("times"), "next_key", "next_hash")
    again = F.struct(F.left("text", third).alias("patch"), (F.col("times") - 1).alias("times"), F.col("key").alias("next_key"), F.col("hash").alias("next_hash"))
    each = whole.select("key", "hash", "absent", "n", "text", F.explode(F.when(F.col("times") > 1, F.array(onward, again)).otherwise(F.array(onward))).alias("s"))
    each = each.select("key", "hash", "absent", "n", "text", "s.times", "s.next_key", "s.next_hash", F.concat(F.left("text", F.col("n") - third), "s.patch").alias("edited"))
    digest = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    kept = ["key", "hash", "absent", "n", "times", "next_key", "next_hash", *(["edited"] if keep_edited else [])]
    signed = each.select(*kept, digest, signatures(F.col("text")).alias("found"), signatures(F.col("edited")).alias("edited_found"))
    signed = materialise(signed, "text-signatures")  # without texts: short rows meet their next ones
    others = signed.select(F.col("key").alias("next_key"), F.col("hash").alias("next_hash"), F.col("found").alias("next_found")).groupBy("next_key", "next_hash").agg(F.first("next_found").alias("next_found"))
    told = signed.join(others, ["next_key", "next_hash"]).withColumn("near_edited", likeness(F.col("found"), F.col("edited_found"))).withColumn("near_next", likeness(F.col("found"), F.col("next_found")))
    copies = told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(F.when(~F.col("absent"), F.col("key")).alias("id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "found", "edited_found", "near_edited", "near_next", *(["edited"] if keep_edited else []))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_next(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("found")).alias("fingerprint"), as_text(F.col("edited_found")).alias("edited_fingerprint"), "near_edited", "near_next")
