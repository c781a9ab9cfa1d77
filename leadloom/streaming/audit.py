"""Audit rows: counters gathered in the pass that writes, in batch and in streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "audit"
ROW = "run string, batch bigint, at timestamp, metrics map<string, bigint>"


def outcome_counters(outcome: str, outcomes: list[str]) -> list[Column]:
    """A counter for every outcome that is foreseen, one for all others, and one for all rows."""
    known = [F.count_if(F.coalesce(F.col(outcome) == o, F.lit(False))).alias(o) for o in outcomes]
    other = F.count_if(~F.coalesce(F.col(outcome).isin(outcomes), F.lit(False))).alias("other")
    return [F.count("*").alias("rows"), *known, other]


def audited_write(df: DataFrame, path: str, run: str, *counters: Column, mode: str = "errorifexists") -> DataFrame:
    """Write df as Parquet and give its audit row: the counters' values in the same pass, without a second scan."""
    seen = Observation(NAME)
    df.observe(seen, *counters).write.mode(mode).parquet(path)
    return audit_row(df.sparkSession, run, 0, seen.get)


def audit_row(spark: SparkSession, run: str, batch: int, metrics: dict) -> DataFrame:
    return spark.createDataFrame([(run, batch, dt.datetime.now(dt.UTC).replace(tzinfo=None), {k: int(v or 0) for k, v in metrics.items()})], ROW)


class AuditListener(StreamingQueryListener):
    """Audit rows of the streams that observe() counters under NAME: one a batch that had input, the last one of a batch wins."""

    def __init__(self):
        self.found: dict[tuple[str, int], tuple] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = (p.observedMetrics or {}).get(NAME)
        if row is not None and p.numInputRows:
            self.found[str(p.id), p.batchId] = (str(p.id), p.batchId, dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None), {k: int(v or 0) for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.found.values()), ROW)
