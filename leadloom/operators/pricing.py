"""Quotes: price, range, annual value and hours of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import clamp_int, round5, round_half_up
from ..plans import catalog
from ..plans.chain import case_map


def normalize_addons(addons: Column, known: dict[str, int]) -> Column:
    """Distinct known add-ons in alphabetical order."""
    return F.array_sort(F.array_intersect(F.array_distinct(F.coalesce(addons, F.array().cast("array<string>"))), F.array(*map(F.lit, sorted(known)))))


def _addons(addons: Column, known: dict[str, int]) -> Column:
    picked = normalize_addons(addons, known)
    return F.aggregate(picked, F.lit(0.0), lambda acc, a: acc + case_map(a, {k: float(v) for k, v in known.items()}, 0.0))


def with_quote(df: DataFrame) -> DataFrame:
    """df with quote_price, quote_low, quote_high, annual_value and hours.

    Malformed rooms and areas fall back to their defaults, unknown types to the base type, unknown
    frequencies to one_time (residential) or weekly (commercial); unknown add-ons are ignored and
    repeated ones charged once. Base tables are CASE expressions, so there is no join.
    """
    commercial = F.col("segment") == "commercial"
    bed, bath = clamp_int(F.col("bedrooms"), 0, 12, 2), clamp_int(F.col("bathrooms"), 1, 10, 2)
    area = clamp_int(F.col("sqft"), 200, 250_000, 2000)
    r_type = case_map(F.col("service_type"), catalog.RESIDENTIAL_TYPE, 1.0)
    c_type = case_map(F.col("service_type"), catalog.COMMERCIAL_TYPE, 1.0)
    home = F.greatest(F.lit(129.0), ((89 + 26 * bed + 34 * bath) * r_type + _addons(F.col("addons"), catalog.RESIDENTIAL_ADDONS)) * case_map(F.col("frequency"), catalog.RESIDENTIAL_FREQUENCY, 1.0))
    site = F.greatest(F.lit(189.0), (F.greatest(F.lit(189.0), 0.12 * area) * c_type + _addons(F.col("addons"), catalog.COMMERCIAL_ADDONS)) * case_map(F.col("frequency"), catalog.COMMERCIAL_FREQUENCY, 0.82))
    home_visits = case_map(F.col("frequency"), {k: v for k, v in catalog.VISITS_PER_MONTH.items() if k != "daily"}, 0.0)
    visits = F.when(commercial, case_map(F.col("frequency"), catalog.VISITS_PER_MONTH, catalog.VISITS_PER_MONTH["weekly"])).otherwise(home_visits)
    price = round5(F.when(commercial, site).otherwise(home))
    hours = F.when(commercial, F.greatest(F.lit(2.0), round_half_up(area / 1200).cast("double"))).otherwise(round_half_up(2 * (1.5 + 0.5 * bed + 0.6 * bath) * r_type) / 2)
    out = df.withColumn("quote_price", price.cast("long"))
    p = F.col("quote_price")
    return out.select(
        "*",
        round5(p * (1 - 0.12)).cast("long").alias("quote_low"),
        round5(p * (1 + 0.12)).cast("long").alias("quote_high"),
        round_half_up(p * visits * 12).cast("long").alias("annual_value"),
        hours.alias("hours"),
    )
