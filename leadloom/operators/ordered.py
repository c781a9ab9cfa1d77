"""Positions and carried values along a total order of all rows, without a window that holds a key or the table.

Rows are dealt by ranges of the order, which a hot key doesn't make uneven: it spans several ranges.
What a range needs of the others is one row per range: its count, or its first or last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

_PART, _AT = "_part", "_at"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df as a table sorted by ranges of `order` (nulls first), with its range's number and its place in it.

    It is written once: ranges are drawn by sampling, so that a second evaluation could cut them elsewhere.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.select("*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(_AT)))


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with each row's number in the order of all rows, from 0 without gaps. `order` has to end with a unique column."""
    return placed(ranged(df, *order), name).drop(_PART, _AT)


def placed(rows: DataFrame, name: str = "position") -> DataFrame:
    """Rows of ranged() with their numbers in the order of all rows."""
    counts = rows.groupBy(_PART).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = counts.select(_PART, before.alias("_start"))
    return rows.join(F.broadcast(starts), _PART).withColumn(name, F.col("_start") + F.col(_AT)).drop("_start")


def carried(df: DataFrame, value: Column, *order: str, name: str, following: bool = False) -> DataFrame:
    """df with `name`: the value of the nearest row up to each (or from it on) whose value isn't null."""
    return run_on(ranged(df, *order), value, name, following)


def run_on(rows: DataFrame, value: Column, name: str, following: bool = False) -> DataFrame:
    """carried() for rows of ranged().

    Within a range it is a running value; a row before its range's first value takes the last one of
    the ranges before. The broadcast side has a row per range.
    """
    rows = rows.withColumn("_value", value)
    own = Window.partitionBy(_PART).orderBy(F.desc(_AT) if following else F.col(_AT)).rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.min_by if following else F.max_by
    ends = rows.where(F.col("_value").isNotNull()).groupBy(_PART).agg(nearest("_value", _AT).alias("_end"))
    parts = rows.select(_PART).distinct().join(ends, _PART, "left")
    others = Window.orderBy(F.desc(_PART) if following else F.col(_PART)).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(_PART, F.last("_end", ignorenulls=True).over(others).alias("_others"))
    run = rows.withColumn("_run", F.last("_value", ignorenulls=True).over(own)).join(F.broadcast(parts), _PART)
    return run.withColumn(name, F.coalesce("_run", "_others")).drop(_PART, _AT, "_value", "_run", "_others")


def with_remainder(df: DataFrame, cap: int, *order: str, name: str = "outcome") -> DataFrame:
    """df with `kept` for the first `cap` rows of the order and `over_cap` for all others: none is dropped."""
    placed = numbered(df, *order, name="_place")
    return placed.withColumn(name, F.when(F.col("_place") < cap, "kept").otherwise("over_cap")).drop("_place")
