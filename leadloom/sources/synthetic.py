"""Seeded synthetic leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def leads(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n leads, the same for the same seed however they are partitioned: every field is a hash of the row's number."""

    def pick(name: str, values: list[str]):
        return F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(len(values))).cast("int"))

    rows = spark.range(n)
    segment = pick("segment", ["residential", "residential", "commercial"])
    return rows.select(
        "id",
        segment.alias("segment"),
        F.when(segment == "commercial", pick("type", ["office", "retail", "medical", "restaurant"])).otherwise(pick("type", ["standard", "deep", "move"])).alias("service_type"),
        pick("frequency", ["weekly", "biweekly", "monthly", "one_time"]).alias("frequency"),
        F.pmod(F.xxhash64("id", F.lit("bed"), F.lit(seed)), F.lit(6)).alias("bedrooms"),
        (1 + F.pmod(F.xxhash64("id", F.lit("bath"), F.lit(seed)), F.lit(3))).alias("bathrooms"),
        (500 + F.pmod(F.xxhash64("id", F.lit("sqft"), F.lit(seed)), F.lit(60)) * 250).alias("sqft"),
        F.array(pick("addon", ["fridge", "oven", "floor_wax", "patio"])).alias("addons"),
    )
