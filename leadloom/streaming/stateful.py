"""Structured Streaming forms of the time-dependent rules; they agree with the batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequential import AnchoredWindow


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(event_id, user_id, allowed) of a stream of events: an anchored window per user kept as state.

    State is two numbers a key and is dropped two windows after the key's last event time. Within a
    micro-batch a key's rows come in any number of pieces, sorted here; across batches they must
    come in order of time, as a watermark's stream does.
    """

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        machine = AnchoredWindow(limit, seconds, start, count)
        rows = pd.concat(pieces).sort_values(["ts", "event_id"])
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        out = [machine.hit(t) for t in micros]
        state.update((machine.start, machine.count))
        last = max(int(micros.iloc[-1] // 1000) + 2000 * seconds, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(last)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": out})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{seconds} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "start long, count int", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums per window and event type; rows later than `late` behind the newest are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark: a key's later rows are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(keys)


def touches(sends: DataFrame, clicks: DataFrame, within: str, late: str) -> DataFrame:
    """Stream-stream join: clicks of a lead up to `within` after a send; both sides' state ends with the watermark."""
    a = sends.select(F.col("event_id").alias("send_id"), F.col("user_id").alias("lead"), F.col("ts").cast("timestamp").alias("sent_at")).withWatermark("sent_at", late)
    b = clicks.select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").cast("timestamp").alias("clicked_at")).withWatermark("clicked_at", late)
    return a.join(b, F.expr(f"lead = user_id AND clicked_at >= sent_at AND clicked_at <= sent_at + interval {within}")).select("send_id", "click_id")
