"""Sealed tables: rows with their own hashes and a seal over all of them, checked when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import row_hash

VERSION = 1


def seal_of(df: DataFrame) -> DataFrame:
    """One row: number of rows and a hash that doesn't depend on their order.

    Rows are hashed where they are and summed; a repeated row counts each time.
    """
    part = F.conv(F.substring("row_hash", 1, 15), 16, 10).cast("decimal(38,0)")
    other = F.conv(F.substring("row_hash", 16, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select("row_hash").agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).alias("a"), F.coalesce(F.sum(other), F.lit(0)).alias("b"))
    return sums.select(F.col("n").alias("rows"), F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("seal"))


def write_sealed(df: DataFrame, path: str, source: str, created_at: str) -> None:
    """Rows under path/rows, the seal under path/seal; Spark's committer makes each appear as a whole."""
    hashed = df.withColumn("row_hash", row_hash(*[F.col(c) for c in sorted(df.columns)]))
    hashed.write.mode("overwrite").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    seal_of(written).select(F.lit(VERSION).alias("version"), F.lit(source).alias("source"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"), "rows", "seal").write.mode("overwrite").json(f"{path}/seal")


def check_sealed(spark: SparkSession, path: str, source: str, as_of: str, max_age_hours: int = 24) -> DataFrame:
    """One row: every problem of a sealed table, an empty array if there is none."""
    rows = spark.read.parquet(f"{path}/rows")
    fields = sorted(c for c in rows.columns if c != "row_hash")
    honest = rows.withColumn("row_hash", row_hash(*[F.col(c) for c in fields]))
    seal = spark.read.schema("version int, source string, created_at timestamp_ntz, rows long, seal string").json(f"{path}/seal")
    j = seal.join(F.broadcast(seal_of(honest).select(F.col("rows").alias("n"), F.col("seal").alias("now"))))
    age = F.timestamp_diff("HOUR", F.col("created_at"), F.lit(as_of).cast("timestamp_ntz"))
    problems = F.array(
        F.when(F.col("version") != VERSION, "version"),
        F.when(F.col("source") != source, "source"),
        F.when(F.col("rows") != F.col("n"), "rows"),
        F.when(F.col("seal") != F.col("now"), "seal"),
        F.when((age < 0) | (age > max_age_hours), "age"),
    )
    return j.select(F.array_compact(problems).alias("problems"))


def latest_per_prefix(files: DataFrame, name: str = "name") -> DataFrame:
    """The last file by name of each prefix before the first dash."""
    return files.groupBy(F.split_part(F.col(name), F.lit("-"), F.lit(1)).alias("prefix")).agg(F.max(name).alias("latest"))
