"""Flow features of a growing packet table at the cost of what a batch touches.

``live.LiveRun`` analyses all packets of the captures a batch touched. Flow features need less: their facts are
additive over time slices, sizes and sources. A batch therefore

* stores its packets by time period and batch;
* finds the (flow, slice) pairs it touched, borders included, and recomputes the facts of those slices alone;
* adds its own size counts, bytes per source and first frames.

Facts lie in one folder per epoch of ``epoch`` batches. The first batch of an epoch folds all earlier facts into a base,
so that a reader opens one base and one epoch's batches, however long the run is. Every folder of a batch or base is
overwritten as a whole, so a batch that runs again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from culvert.operators import flows as FL
from culvert.streaming.live import LiveRun

PERIOD_US = 3_600_000_000
LISTED_PERIODS = 1_000


class LiveFlows(LiveRun):
    """A stream that keeps ``flow_features`` per ``keys`` current.

    ``ticks`` tells for each batch how many packets it brought, how many stored ones were scanned (the periods of the touched
    slices) and how many of those lie in touched slices. Packets may come late and in any order. A packet whose key or time
    is null belongs to no flow and is stored only. Columns of packets other than the keys, ``t_us``, ``size``, ``src`` and ``frame`` are
    stored, too; ``batch``, ``epoch`` and ``period`` are this class's own and may not occur.
    """

    OWN = ("batch", "epoch", "period")

    def __init__(
        self, root: str, keys: Sequence[str], list_keys: Sequence[str] | None = None, max_packets: int | None = None,
        epoch: int = 64, period_us: int = PERIOD_US, slice_us: int = FL.SLICE_US,
    ):
        super().__init__(root, lambda df: df, max_packets=max_packets)
        self.keys, self.list_keys = list(keys), list(list_keys or list(keys)[:1])
        self.epoch, self.period_us, self.slice_us = epoch, max(period_us, slice_us), slice_us

    # --- one batch ---

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clash = [c for c in batch.columns if c in self.OWN]
        if clash:
            raise ValueError(f"packet columns with names of the store: {clash}")
        if batch_id and batch_id % self.epoch == 0:
            self._fold(spark, batch_id // self.epoch)
        if batch.isEmpty():
            return
        period = F.floor(F.col("t_us") / F.lit(self.period_us)).cast("bigint")
        stored = f"{self.packets_path}/batch={batch_id}"
        batch.withColumn("period", period).write.mode("overwrite").partitionBy("period").parquet(stored)
        keyed = reduce(lambda a, c: a & F.col(c).isNotNull(), self.keys, F.col("t_us").isNotNull())
        own = spark.read.schema(batch.withColumn("period", period).schema).parquet(stored).filter(keyed)

        touched_path = f"{self.touched_path}/batch={batch_id}"
        FL.with_margins(own, self.keys, self.slice_us).select(*self.keys, "_slice").distinct().write.mode("overwrite").parquet(touched_path)
        touched = spark.read.parquet(touched_path)
        seen, used = Observation(), Observation()
        near = spark.read.schema(self._packet_schema(batch)).parquet(self.packets_path).filter((F.col("batch") <= batch_id) & self._periods(touched)).filter(keyed)
        near = near.observe(seen, F.count(F.lit(1)).alias("n"))
        rows = FL.with_margins(near, self.keys, self.slice_us).join(touched, [*self.keys, "_slice"], "left_semi")
        rows = rows.observe(used, F.count(F.lit(1)).alias("n"))
        self._put(FL.slice_facts(FL.positions(rows, self.keys), self.keys), "slices", batch_id)
        self._put(FL.size_counts(own, self.keys), "sizes", batch_id)
        self._put(FL.source_bytes(own, self.keys), "sources", batch_id)
        self._put(own.groupBy(*self.list_keys).agg(F.min(F.struct("frame", "src")).alias("first")), "leaders", batch_id)
        count = spark.read.parquet(stored).count()
        tick = [(batch_id, count, seen.get["n"], used.get["n"])]
        spark.createDataFrame(tick, "batch_id bigint, packets bigint, scanned bigint, used bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ticks/batch={batch_id}")
        self.packets_seen = self.ticks(spark).agg(F.sum("packets")).first()[0]

    @staticmethod
    def _packet_schema(batch: DataFrame) -> str:
        return f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, batch bigint, period bigint"

    def _periods(self, touched: DataFrame):
        """Periods that can hold packets of touched slices: a filter on folders. Many periods are given as one range."""
        per = lambda shift: F.floor((F.col("_slice") + shift) * self.slice_us / F.lit(self.period_us)).cast("bigint")
        periods = touched.select(F.explode(F.array_distinct(F.array(per(-1), per(0), per(1)))).alias("p")).distinct()
        listed = [r["p"] for r in periods.limit(LISTED_PERIODS + 1).collect()]
        if len(listed) <= LISTED_PERIODS:
            return F.col("period").isin(listed)
        low, high = periods.agg(F.min("p"), F.max("p")).first()
        return F.col("period").between(low, high)

    # --- tables of facts ---

    def _put(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/epoch={batch_id // self.epoch}/batch={batch_id}")

    @staticmethod
    def _open(spark: SparkSession, path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _facts(self, spark: SparkSession, table: str, epoch: int) -> DataFrame | None:
        """Facts up to the end of an epoch, one row per key: the base below it and the batches in it."""
        base = self._open(spark, f"{self.root}/bases/{table}/epoch={epoch}") if epoch else None
        fresh = self._open(spark, f"{self.root}/{table}/epoch={epoch}")
        parts = [df for df in (None if base is None else base.withColumn("batch", F.lit(-1)), fresh) if df is not None]
        if not parts:
            return None
        both = reduce(DataFrame.unionByName, parts)
        if table == "slices":  # the last batch that touched a slice saw all its packets
            rest = [c for c in both.columns if c not in (*self.keys, "_slice", "batch")]
            last = both.groupBy(*self.keys, "_slice").agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
            return last.select(*self.keys, "_slice", *[F.col(f"_l.{c}").alias(c) for c in rest])
        if table == "leaders":
            return both.groupBy(*self.list_keys).agg(F.min("first").alias("first"))
        by, value = ("size", "_c") if table == "sizes" else ("src", "_b")
        return both.groupBy(*self.keys, by).agg(F.sum(value).alias(value))

    def _fold(self, spark: SparkSession, epoch: int) -> None:
        for table in ("slices", "sizes", "sources", "leaders"):
            facts = self._facts(spark, table, epoch - 1)
            if facts is not None:
                facts.write.mode("overwrite").parquet(f"{self.root}/bases/{table}/epoch={epoch}")

    # --- what readers see ---

    def ticks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/ticks").drop("batch")

    def results(self, spark: SparkSession, flows: DataFrame | None = None) -> DataFrame:
        """Features of all flows, or of those in ``flows`` (the keys), from stored facts; no packet is read."""
        epoch = self.ticks(spark).agg(F.max("batch_id")).first()[0] // self.epoch
        slices, sizes, sources, leaders = (self._facts(spark, t, epoch) for t in ("slices", "sizes", "sources", "leaders"))
        if flows is not None:
            slices, sizes, sources = (df.join(flows, self.keys, "left_semi") for df in (slices, sizes, sources))
        leaders = leaders.select(*self.list_keys, F.col("first.src").alias("up_src"))
        return FL.features_of(
            FL.merge_slices(slices, self.keys), FL.percentiles(sizes, self.keys), FL.split_bytes(sources, leaders, self.keys, self.list_keys), self.keys
        )

    def changed(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Features of the flows a batch touched, as they are now."""
        touched = spark.read.parquet(f"{self.touched_path}/batch={batch_id}")
        return self.results(spark, touched.select(*self.keys).distinct())
