"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set a local session, as of tests, gets
    a new one; a cluster must set one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame as a Parquet table in the shared folder and reads it: the lineage ends there, each row is
    computed once, and the table outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, order: list[str], to: str, salts: int = 256) -> DataFrame:
    """Adds `to`: 0, 1, 2, ... without gaps within each value of `key`, without ever ordering a whole key in one task.

    The rows of a key are dealt by a hash of `order` to `salts` parts; each part is numbered by itself, and starts
    after the rows of the parts before it. Rows that agree in `order` get the numbers between them in any order."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(key, "_part").orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")))
        .withColumn(to, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_part", "_row", "_key", "_p", "_start")
    )
