"""Event-time operators: first touches, attribution as of a time, windows and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_touch(events: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """First time of each kind per key."""
    return events.groupBy(key).agg(*[F.min(F.when(F.col("kind") == k, F.col("ts"))).alias(f"first_{k}") for k in kinds])


def as_of(events: DataFrame, key: str, is_source: Column, is_target: Column, value: str) -> DataFrame:
    """Target rows with `source`: the value of the latest source row of the key at or before them.

    Both kinds are in one table, so one sort by key and time serves; no join, no pairs.
    """
    order = [F.col("ts"), F.when(is_source, 0).otherwise(1), F.col("id")]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("source", F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(w)).where(is_target)


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, slide: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), width, slide), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(F.col("ts").cast("timestamp"), gap), key).agg(F.count("*").alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """(left_id, right_id): right rows of the same key up to `seconds` after a left row.

    Time is cut into buckets of that width: a left row meets its own bucket and the next, so the join
    is on key and bucket and never compares a key's rows with all others.
    """
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    a = left.select(F.col("id").alias("left_id"), key, F.col("ts").alias("_a"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    b = right.select(F.col("id").alias("right_id"), key, F.col("ts").alias("_t"), bucket.alias("_b"))
    near = (F.col("_t") >= F.col("_a")) & (F.col("_t") <= F.col("_a") + F.expr(f"interval '{seconds}' second"))
    return a.join(b, [key, "_b"]).where(near).select("left_id", "right_id")
