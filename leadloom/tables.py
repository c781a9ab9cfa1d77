"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's folder; a local session without one gets a folder of its machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints/leadloom").rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the shared folder: what reads it never recomputes df, and a lost executor costs
    only rereading. The table goes when the session's JVM ends, or by dropped()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """written(), and the values of named aggregates that the same pass has taken."""
    seen = Observation()
    table = written(df.observe(seen, *metrics))
    return table, seen.get


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that written() has returned and nothing will read again."""
    for table in tables:
        for f in table.inputFiles()[:1]:
            at, files = _path(table.sparkSession, f)
            files.delete(at.getParent(), True)
