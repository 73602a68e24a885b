"""Session settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # constraint inference over wide derived session structs can take exponential planning time
    "spark.sql.constraintPropagation.enabled": "false",
    # HotSpot never compiles methods over 8000 bytes; above that, plain (split) code generation is faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a result may have columns that differ in case alone (the class Other, and other)
    "spark.sql.caseSensitive": "true",
}

#: whether Spark removes a query's shuffle files when the query ends, not when the driver's garbage collector finds them unused
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "culvert", **conf: str) -> SparkSession:
    """A session with the settings above; anything passed in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A folder every executor can reach, below the one the cluster names for checkpoints.

    Only a local session without ``spark.checkpoint.dir`` (a test) gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="culvert-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, purpose) if "://" not in root else f"{root.rstrip('/')}/{purpose}"


def materialise(df: DataFrame, purpose: str, rows_a_file: int = 0) -> DataFrame:
    """Write a result that several later steps read, and read it back; a file holds at most ``rows_a_file`` rows, if given.

    The table lives in the shared folder, so a lost executor costs nothing already computed, and the shuffle files of the job,
    which nobody reads again, go as soon as it is written.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark, purpose)}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)
