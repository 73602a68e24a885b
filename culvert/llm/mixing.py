"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate: what its target weight is of the whole, over what it holds. A document's
count inverts the Poisson distribution of that mean at a uniform number made from a hash of seed and id; the document
is exploded by its count, and the copies go to random places of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.llm.common import free_name, table
from culvert.session import materialise

SEED, EPOCHS = 17, 1.0
#: a mean above this is the sum of equal parts, each inverted at a uniform number of its own
PART_MEAN = 8.0
#: counts of one part; a mean of 8 exceeds them with probability below 1e-35, the uniform numbers have 52 bits
MOST = 64


def rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """source, rate, parts, cdf: a row for each source of the table. A text holds its bytes and one more for its end."""
    held = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1)).cast("double").alias("held"))
    if weights is None:
        weighed = held.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = held.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("name")), "left").select("source", "held", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = materialise(weighed, "held")
    all_held, all_weight = weighed.agg(F.sum("held"), F.sum("weight")).first()
    rate = F.lit(epochs) * F.lit(all_held) * F.col("weight") / (F.lit(all_weight) * F.col("held")) if all_weight else F.lit(0.0)
    mean = weighed.select("source", rate.alias("rate"))
    mean = mean.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("long"))
    part = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, lambda s, k: F.struct((s["p"] * part / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * part / k)).alias("cdf")))
    return mean.select("source", "rate", "parts", grown["cdf"].alias("cdf"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of the documents so that each source holds its target weight of the result, in random order.

    Without ``weights`` every source weighs the same; sources that ``weights`` doesn't name weigh nothing. Adds
    copy_no (from 1) behind the columns of ``docs``; a column of that name is replaced. Null texts count one byte, a
    null source is a source, a null id is an id. Rows with the same id and source get the same count, each its own
    copies. An empty table gives an empty result.
    """
    base = docs.drop("copy_no")
    source, parts, cdf, times, place = (free_name(base, n) for n in ("__source", "__parts", "__cdf", "__times", "__place"))
    per_source = materialise(rates(base, source_col, text_col, weights, epochs), "rates").select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    counted = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col(parts)), F.lit(0),
        lambda n, part: n + F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(str(seed)), name, part.cast("string")))),
    )
    joined = base.join(per_source, F.col(source_col).eqNullSafe(F.col(source))).withColumn(times, counted).filter(F.col(times) > 0)
    copies = joined.select(*[F.col(f"`{c}`") for c in base.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy_no"))
    placed = copies.withColumn(place, F.xxhash64(F.lit(seed), name, "copy_no"))
    return placed.repartition(F.col(place)).sortWithinPartitions(place).drop(place)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH held AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS held FROM documents GROUP BY source),
r AS (SELECT source, {EPOCHS} * (sum(held) OVER ()) * 1.0 / ((count(*) OVER ()) * held) AS rate FROM held),
m AS (SELECT source, greatest(1, ceil(rate / {PART_MEAN}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {PART_MEAN})) AS part FROM r),
k AS (SELECT source, parts, part, unnest(range(0, {MOST + 1})) AS k FROM m),
c AS (SELECT source, parts, k, sum(exp(-part) * pow(part, k) / gamma(k + 1.0)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT d.doc_id, m.source, unnest(range(1, m.parts + 1)) AS p FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
v AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || p), 1, 13))::BIGINT / {float(2**52)} AS u FROM u),
n AS (SELECT v.doc_id, count(*) AS times FROM v JOIN c ON v.source IS NOT DISTINCT FROM c.source AND c.cdf <= v.u GROUP BY v.doc_id)
SELECT d.*, unnest(range(1, n.times + 1))::INTEGER AS copy_no FROM documents d JOIN n ON d.doc_id = n.doc_id
"""
