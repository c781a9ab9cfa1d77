"""Segments of prospects from keywords and industry codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, ascii_edges, fold_accents, word
from ..plans import catalog


def _words(values: list[str]) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")


def with_segment(df: DataFrame, text: Column, code: Column, signal: Column, segments: dict | None = None) -> DataFrame:
    """df with segment, confidence and matched: the best-scoring segment, ties by the catalog's order.

    Two points for each keyword that occurs anywhere in the folded text, four for an exact code or
    two for one with the same first four digits. A finished permit decides alone. The catalog is a
    literal in the plan, so rows are never multiplied by it; the scores are a column of their own,
    so they are computed once a row.
    """
    segments = segments or catalog.SEGMENTS
    rows = df.select("*", F.lower(fold_accents(F.coalesce(text, F.lit("")))).alias("_hay"), F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "").alias("_code"), signal.alias("_signal"))
    hay, digits = F.col("_hay"), F.col("_code")
    scored = []
    for order, (name, (_, keywords, codes)) in enumerate(segments.items()):
        near = F.exists(_words(codes), lambda c: F.startswith(digits, F.substring(c, 1, 4)))
        by_code = F.when(digits == "", 0).when(F.array_contains(_words(codes), digits), 4).when(near, 2).otherwise(0)
        scored.append(F.struct(F.filter(_words(keywords), lambda k: F.contains(hay, k)).alias("words"), by_code.alias("by_code"), F.lit(-order).alias("order"), F.lit(name).alias("segment")))

    def ranked(x: Column) -> Column:
        return F.struct((F.size(x["words"]) * 2 + x["by_code"]).alias("score"), x["order"].alias("order"), x["segment"].alias("segment"), x["words"].alias("words"), x["by_code"].alias("by_code"))

    rows = rows.withColumn("_ranked", F.sort_array(F.transform(F.array(*scored), ranked), asc=False))
    rows = rows.select("*", F.get("_ranked", F.lit(0)).alias("_best"), F.get("_ranked", F.lit(1))["score"].alias("_second"))
    best, permit = F.col("_best"), F.coalesce(F.col("_signal") == "permit_finaled", F.lit(False))
    sure = F.least(F.lit(1.0), best["score"] / 6 * F.when(best["score"] > F.col("_second"), 1.0).otherwise(0.6))
    coded = F.when(best["by_code"] == 4, F.array(F.concat(F.lit("naics:"), digits))).when(best["by_code"] == 2, F.array(F.concat(F.lit("naics~"), digits))).otherwise(F.array().cast("array<string>"))
    found = best["score"] > 0
    return rows.select(
        *df.columns,
        F.when(permit, "post_construction").when(found, best["segment"]).alias("segment"),
        F.when(permit, 0.9).when(found, F.floor(sure * 100 + 0.5) / 100).otherwise(0.0).alias("confidence"),
        F.when(permit, F.array(F.lit("permit_finaled"))).when(found, F.concat(best["words"], coded)).otherwise(F.array().cast("array<string>")).alias("matched"),
    )


def sector(code: Column) -> Column:
    """First two digits of an industry code, null with fewer."""
    d = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    return F.when(F.length(d) >= 2, F.substring(d, 1, 2).cast("int"))


def sector_segment(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in catalog.SECTOR_SEGMENT.items():
        out = F.when(sector(code) == k, v).otherwise(out)
    return out


# Words of an official type, in the order in which they are asked for.
_TYPE_WORDS = [
    ("restaurants", r"restaurant|food facility|food service|coffee|deli|bakery|caterer|market|taquer|pizza|grill|bar\b"),
    ("offices", "health care|medical|dental|clinic"),
    ("offices", "school|conference|church"),
    ("retail", "retail|store|shop"),
    ("property_managers", "property|real estate|management"),
    ("post_construction", "construction|contractor"),
]


def official_segment(code: Column, kind: Column, description: Column) -> Column:
    """Segment of a company by its industry code, else by the words of its official type, else (without a type) its description."""
    text = F.lower(F.coalesce(F.nullif(kind, F.lit("")), description, F.lit("")))
    out = F.lit(None).cast("string")
    for segment, words in reversed(_TYPE_WORDS):
        out = F.when(text.rlike(ascii_edges(words)), segment).otherwise(out)
    return F.coalesce(sector_segment(code), out)


def inbound_category(text: Column) -> Column:
    """First category with a signal in the message, else unrelated."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit("unrelated")
    for name, signals in reversed(catalog.INBOUND_SIGNALS):
        out = F.when(any_of(t, [word(s) for s in signals]), name).otherwise(out)
    return out


def license_rating(license_type: Column) -> Column:
    """Rating of a license type, padded to two characters; null without one."""
    code = F.lpad(license_type, F.greatest(F.lit(2), F.length(license_type)), F.lit("0"))
    out = F.lit(None).cast("int")
    for rating, types in catalog.LICENSE_RATING.items():
        out = F.when(code.isin(types), rating).otherwise(out)
    return out
