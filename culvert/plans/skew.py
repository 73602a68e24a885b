"""Ways to keep one hot key from landing in one task.

A window or a join keyed on something an observer does not control (a peer pair, an SPI, a
traffic class) may meet a key with a third of all rows. Three exact tools are used instead of
a plain window or join on such keys:

* ``sliced_lag``    previous value in order, through fixed-width slices of the order column;
* ``attach``        join per-key facts to rows, salting the keys counted as hot;
* ``exact_median``  median per key by counting value bands first and reading one band only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culvert.session import materialise

#: a key that holds more than one part in so many of a shuffle partition's even share is split
PARTS = 4
#: columns that are cheap to hash into a salt
NARROW = ("bigint", "int", "smallint", "tinyint", "boolean", "double", "string")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def slice_of(order: Column, width: int) -> Column:
    """Index of the fixed-width slice an integer order value falls into."""
    return F.floor(order / F.lit(width)).cast("bigint")


def sliced_lag(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], width: int, tie: str | None = None
) -> DataFrame:
    """Add ``lag(value)`` columns over ``keys`` ordered by ``order`` without one task per key.

    ``values`` maps a source column to the name of its lagged copy. Rows are windowed inside
    (keys, slice); only the first row of a slice looks at the carry, which is the last row of
    the nearest earlier slice and comes from one summary row per slice.
    """
    ordering = [order] + ([tie] if tie else [])
    sliced = df.withColumn("_slice", slice_of(F.col(order), width))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*ordering)
    rows = sliced.withColumn("_first", F.row_number().over(inner) == 1)
    for source, target in values.items():
        rows = rows.withColumn(target, F.lag(source).over(inner))
    last_at = F.struct(*ordering)
    summary = sliced.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*[F.col(v).alias(v) for v in values]), last_at).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    carry = summary.select(*keys, "_slice", F.lag("_last").over(across).alias("_carry"))
    right = carry.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_slice").alias("_r_slice"), "_carry")
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_slice") == F.col("_r_slice")],
    )
    joined = rows.join(right, on, "left")
    for source, target in values.items():
        joined = joined.withColumn(
            target, F.when(F.col("_first"), F.col("_carry")[source]).otherwise(F.col(target))
        )
    return joined.drop("_slice", "_first", "_carry", "_r_slice", *[f"_r_{k}" for k in keys])


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "left",
    share: int | None = None,
) -> DataFrame:
    """Join one fact row per key to many rows; ``weight`` is the key's row count in ``facts``.

    The facts are written once, since their total, the hot keys and the join read them. A key that holds at least 1 / ``share``
    of all rows (``PARTS`` times the shuffle partitions, if not given) is spread over sub-keys in proportion, two for each such
    share. There are at most ``share`` such keys, so their broadcast list is bounded by the number of partitions, and
    the list is complete; every other key takes the ordinary shuffled join.
    """
    keys, spark = list(keys), rows.sparkSession
    share = share or PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = materialise(facts, "facts")
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.filter(F.col(weight).cast("decimal(38,0)") * share >= F.lit(total)).select(*keys, F.ceil(F.col(weight) * F.lit(2 * share) / F.lit(max(1, total))).cast("int").alias("_hot"))
    if hot.isEmpty():
        return rows.join(facts, keys, how)
    narrow = [c for c, kind in rows.dtypes if kind in NARROW and c not in keys][:3]
    # the partition number spreads exact copies of one row, which any hash of the row would keep together
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in narrow or rows.columns], F.spark_partition_id()), F.col("_hot")).cast("int")
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_hot"), F.lit(1)) - 1)
    salted_facts = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies))
    return salted_rows.drop("_hot").join(salted_facts.drop("_hot"), [*keys, "_salt"], how).drop("_salt")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, band: int, out: str = "median") -> DataFrame:
    """Exact median (mean of the two middle values) of an integer column per key.

    Values are counted per (key, value), then per (key, band). The band holding each middle
    rank is found on the band counts, and only that band's distinct values are ranked, so no
    task ever holds more than ``band`` distinct values of a key. Adds ``n``, the value count.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_band", slice_of(F.col(value), band))
    bands = counts.groupBy(*keys, "_band").agg(F.sum("_c").alias("_bc"))
    per_key = Window.partitionBy(*keys)
    bands = bands.withColumn("_upto", F.sum("_bc").over(per_key.orderBy("_band"))).withColumn(
        "n", F.sum("_bc").over(per_key)
    )
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    wanted = bands.withColumn("_rank", F.explode(middle)).filter(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_bc"))
    )
    wanted = wanted.select(*keys, "_band", "n", (F.col("_upto") - F.col("_bc")).alias("_before"), "_rank")
    in_band = Window.partitionBy(*keys, "_band").orderBy(value)
    ranked = counts.withColumn("_in", F.sum("_c").over(in_band))
    hit = ranked.join(wanted, [*keys, "_band"]).filter(
        (F.col("_rank") - F.col("_before") < F.col("_in"))
        & (F.col("_rank") - F.col("_before") >= F.col("_in") - F.col("_c"))
    )
    return hit.groupBy(*keys).agg(F.avg(value).alias(out), F.max("n").alias("n"))


def sliced_rank(df: DataFrame, keys: Sequence[str], order: str, width: int, out: str = "rank", tie: Sequence[str] = ()) -> DataFrame:
    """Zero-based rank of each row within ``keys`` by ``order``, without one task per key.

    Rows are numbered inside (keys, slice); the rows of earlier slices come from one count per slice.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_of(F.col(order), width))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(order, *tie)
    numbered = sliced.withColumn("_in", F.row_number().over(inner) - 1)
    ranked = numbered.join(offsets, [*keys, "_slice"])
    return ranked.withColumn(out, F.col("_offset") + F.col("_in")).drop("_slice", "_in", "_offset")


def one_row(*rows: DataFrame) -> DataFrame:
    """Single-row aggregates side by side, as one row; no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
