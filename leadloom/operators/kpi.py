"""Dashboards: totals, conversion, groups, series, search pages and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` days, 365 at most, before as_of."""
    return df.where(F.col(column) >= F.expr(f"timestamp_ntz '{as_of}' - interval '{min(days, 365)}' day"))


def totals(leads: DataFrame) -> DataFrame:
    """Count, pipeline and annual value, mean score and the won part, in one pass."""
    won = F.col("status") == "won"
    out = leads.agg(
        F.count("*").alias("leads"),
        F.coalesce(F.sum("quote_price"), F.lit(0)).alias("pipeline"),
        F.coalesce(F.sum("annual_value"), F.lit(0)).alias("annual"),
        F.floor(F.coalesce(F.avg("score"), F.lit(0.0)) + 0.5).alias("avg_score"),
        F.count_if(won).alias("won"),
        F.coalesce(F.sum(F.when(won, F.col("quote_price"))), F.lit(0)).alias("revenue"),
    )
    rate = F.when(F.col("leads") > 0, F.floor(F.col("won") / F.col("leads") * 1000 + 0.5) / 10).otherwise(0.0)
    return out.withColumn("conversion", rate)


def counts(df: DataFrame, *keys: str, **sums: str) -> DataFrame:
    """Rows per group and sums of columns by alias."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in sums.items()])


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def traffic_source(source: Column) -> Column:
    """The label of a lead's source: what the reader means by it, so that leads group by the label."""
    return F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("direct"))


def search(leads: DataFrame, status: str = "", temperature: str = "", segment: str = "", text: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of leads by score and age, each row with the number of all that match; unknown filters are ignored."""
    known = {"new", "engaged", "quoted", "booked", "won", "lost", "customer", "spam"}
    for column, value in (("status", status if status in known else ""), ("temperature", temperature), ("segment", segment)):
        if value:
            leads = leads.where(F.col(column) == value)
    if text:
        leads = leads.where(F.col("email").ilike(f"%{text}%") | F.col("zip").ilike(f"%{text}%") | F.coalesce(F.col("phone"), F.lit("")).ilike(f"%{text}%"))
    number = leads.agg(F.count("*").alias("total"))
    page = leads.orderBy(F.desc("score"), F.desc("created_at"), "id").offset(offset).limit(min(limit, 500))
    return page.join(F.broadcast(number))


def engagement(sends: DataFrame) -> DataFrame:
    """Sent, opened, clicked and failed mails; sums are null on empty input, as counts of flags are."""
    flag = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    return sends.agg(flag("sent").alias("sent"), flag("opened").alias("opened"), flag("clicked").alias("clicked"), flag("failed").alias("failed"))


def reject_reasons(df: DataFrame, reason: str = "verdict", n: int = 12) -> DataFrame:
    """Reasons before a colon by frequency; null is a reason too."""
    label = F.split_part(F.col(reason), F.lit(":"), F.lit(1)).alias("reason")
    return top(df.groupBy(label).agg(F.count("*").alias("n")), n, F.desc("n"), F.asc_nulls_first("reason"))
