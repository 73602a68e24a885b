"""Result tables partitioned by job: replace, delete, read."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def last_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row per key, as an ordered aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def _partition(root: str, table: str, job_id: str) -> str:
    """Folder of a job, with the characters escaped that Spark escapes in partition values."""
    value = re.sub(r"[\x00-\x1f\"#%'*/:=?\\{}\[\]^\x7f]", lambda m: f"%{ord(m[0]):02X}", job_id)
    return f"{root.rstrip('/')}/{table}/job_id={value}"


def save_job(root: str, job_id: str, tables: dict[str, DataFrame]) -> None:
    """Replace everything stored for a job. A table without rows clears what was there.

    Each table's partition folder is overwritten on its own, so other jobs are untouched and an
    empty result needs no special case.
    """
    for name, df in tables.items():
        rows = df.filter(F.col("job_id") == job_id).drop("job_id") if "job_id" in df.columns else df
        rows.write.mode("overwrite").parquet(_partition(root, name, job_id))


def save_jobs(root: str, name: str, df: DataFrame) -> None:
    """Replace the partitions of every job that has rows in ``df``, in one write."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{root.rstrip('/')}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A result table; ids of jobs are text as saved, whatever they look like."""
    path = f"{root.rstrip('/')}/{name}"
    found = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path).schema
    typed = StructType([StructField(f.name, StringType() if f.name == "job_id" else f.dataType) for f in found])
    return spark.read.schema(typed).option("basePath", path).parquet(path)


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    try:
        read_table(spark, root, name)
        return True
    except AnalysisException:
        return False


def delete_job(spark: SparkSession, root: str, job_id: str, tables: Sequence[str]) -> bool:
    """Drop a job's partitions; True when one was there. Audit entries are not a job table and stay."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = False
    for name in tables:
        path = hadoop.Path(_partition(root, name, job_id))
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True) or found
    return found
