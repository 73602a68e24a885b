"""What the operators of this subpackage share: words, row keys, Arrow maps over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold about this many bytes; one longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: stands for a null id where a plain long is needed; sorts before every other id
NULL_ID = -(2**63)

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words_of(col: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def row_uid(id_col: str, text_col: str) -> Column:
    """Names a document by id and text: rows that share an id stay apart, exact repeats of a row fall together."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(text_col), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts don't pile up in one batch."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes and let Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def added(df: DataFrame, columns: str) -> str:
    """DDL of a table with more columns behind its own."""
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {columns}"


def append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; empty for null."""
    return [b"" if t is None else t for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


class Memo(dict):
    """A bounded cache: ``memo[key]`` computes what is missing; a full cache starts anew."""

    def __init__(self, compute: Callable, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit key of two keys, in order."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + right
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Keys:
    """Sorted evenly spread 64-bit keys, found by shards of their high bits."""

    SHARD_BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - self.SHARD_BITS)
        self.begin = np.searchsorted(keys >> self.shift, np.arange((1 << self.SHARD_BITS) + 1, dtype=np.uint64)).astype(np.int64)

    def __reduce__(self):
        return Keys, (self.keys,)  # a copy finds its shards anew, which is less than sending them

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands; the number of keys if it is unknown."""
        shard = (keys >> self.shift).astype(np.int64)
        at, end = self.begin[shard], self.begin[shard + 1]
        out = np.full(len(keys), len(self.keys), np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            own = self.keys[here]
            hit = own == keys[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[(own < keys[left]) & (at[left] < end[left])]
        return out
