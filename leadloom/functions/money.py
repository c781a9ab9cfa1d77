"""Rounding and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """Towards plus infinity at one half."""
    return F.floor(c + 0.5)


def round5(c: Column) -> Column:
    return F.floor(c / 5 + 0.5) * 5


def clamp_int(c: Column, low: int, high: int, default: int) -> Column:
    """The leading integer of a value, held within bounds; default where there is none."""
    n = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.least(F.greatest(F.coalesce(n, F.lit(default)), F.lit(low)), F.lit(high))


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))
