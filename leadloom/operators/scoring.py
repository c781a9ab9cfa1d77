"""Explainable scores of leads and prospects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import email_domain, free_mail, free_mail_name
from ..plans import catalog
from ..plans.chain import all_failures

Points = list[tuple[str, Column]]


def _explained(df: DataFrame, points: Points, prefix: str) -> DataFrame:
    """Score clamped to 0..100 and the reasons, an array of structs of points and reason, for the rules that gave any."""
    parts = [(r, F.coalesce(p.cast("int"), F.lit(0))) for r, p in points]
    total = reduce(lambda a, b: a + b, [p for _, p in parts])  # a plain sum: compiled with the rest of the stage
    given = F.filter(F.array(*[F.struct(p.alias("points"), F.lit(r).alias("reason")) for r, p in parts]), lambda x: x["points"] != 0)
    return df.select("*", F.least(F.greatest(total, F.lit(0)), F.lit(100)).alias(f"{prefix}score"), given.alias(f"{prefix}reasons"))


def temperature(score: Column) -> Column:
    return F.when(score >= catalog.HOT, "hot").when(score >= catalog.WARM, "warm").otherwise("cold")


def score_leads(quoted: DataFrame, as_of: str) -> DataFrame:
    """Quoted leads with score, temperature and reasons; as_of stands for today."""
    c = F.col
    days = F.datediff(c("preferred_date"), F.lit(as_of).cast("date"))
    commercial = c("segment") == "commercial"
    points: Points = [
        ("commercial", F.when(commercial, 25)),
        ("frequency", F.when(c("frequency").isin("weekly", "daily"), 25).when(c("frequency") == "biweekly", 20).when(c("frequency") == "monthly", 14)),
        ("annual_value", F.when(c("annual_value") >= 10000, 20).when(c("annual_value") >= 4000, 13).when(c("annual_value") > 0, 7)),
        ("price", F.when(c("quote_price") >= 400, 10).when(c("quote_price") >= 250, 6)),
        ("phone", F.when(c("phone").isNotNull() & (c("phone") != ""), 10).otherwise(-5)),
        ("preferred_date", F.when(days <= 3, 15).when(days <= 7, 10).when(days <= 14, 5)),
        ("area", F.when(c("in_area"), 8).otherwise(-15)),
        ("business_mail", F.when(commercial & (email_domain(c("email")) != "") & ~free_mail(c("email")), 7)),
        ("message", F.when(c("message_length") > 40, 5)),
        ("paid_click", F.when(F.lower("utm_medium").isin(catalog.PAID_MEDIA) | (F.coalesce(c("gclid"), F.lit("")) != ""), 5)),
    ]
    out = _explained(quoted, points, "")
    return out.withColumn("temperature", temperature(c("score")))


def score_prospects(df: DataFrame) -> DataFrame:
    """Prospects that have segment, confidence, annual_value and visit_value, with icp_score and icp_reasons."""
    c = F.col
    weight = F.lit(0)
    for name, (w, _, _) in catalog.SEGMENTS.items():
        weight = F.when(c("segment") == name, w).otherwise(weight)
    finaled, opened = c("signal_type") == "permit_finaled", c("signal_type") == "new_business"
    own_mail = (F.coalesce(c("email"), F.lit("")) != "") & ~free_mail_name(c("email"))
    points: Points = [
        ("segment", weight),
        ("value", F.when(c("annual_value") >= 20000, 22).when(c("annual_value") >= 8000, 15).when(c("annual_value") > 0, 8).when(c("visit_value") >= 500, 10)),
        ("finished_permit", F.when(finaled & (c("signal_days") <= 14), 20).when(finaled & (c("signal_days") <= 45), 10)),
        ("valuation", F.when(finaled & (c("valuation") >= 100000), 8)),
        ("new_business", F.when(opened & (c("signal_days") <= 60), 14).when(opened & (c("signal_days") <= 180), 7)),
        ("own_mail", F.when(own_mail, 8)),
        ("phone", F.when(F.coalesce(c("phone"), F.lit("")) != "", 5)),
        ("website", F.when(F.coalesce(c("website"), F.lit("")) != "", 5)),
        ("area", F.when(c("in_area"), 8).otherwise(-25)),
        ("unsure_segment", F.when(c("confidence") < 0.4, -8)),
    ]
    return _explained(df, points, "icp_")


def prospect_verdict(df: DataFrame, threshold: int = 45) -> Column:
    """First reason against contacting a prospect; qualified without any."""
    c = F.col
    return (
        F.when(F.coalesce(c("email"), F.lit("")) == "", "no_email")
        .when(~c("in_area"), "out_of_service_area")
        .when(c("suppressed_by").isNotNull(), "suppressed")
        .when(c("unsubscribed"), "previously_unsubscribed")
        .when(c("lead_status").isNotNull(), F.concat(F.lit("already_a_lead:"), c("lead_status")))
        .when(c("icp_score") < threshold, "below_threshold")
        .otherwise("qualified")
    )


def enrichment_plan(df: DataFrame) -> DataFrame:
    """score, rating, stage, changes, action and not_proposed for companies with has_channel, in_area, official, has_address,
    segment, email, website, phone, and their current old_rating, old_stage and service_area.

    The service area is proposed only where it is blank: what somebody wrote stays.
    """
    c = F.col
    points: Points = [
        ("channel", F.when(c("has_channel"), 25)),
        ("area", F.when(c("in_area"), 15)),
        ("official", F.when(c("official"), 10)),
        ("address", F.when(c("has_address"), 10)),
    ]
    out = _explained(df, points, "plan_")
    rating = F.when(c("plan_score") >= 70, 4).when(c("plan_score") >= 50, 3).when(c("plan_score") >= 30, 2).otherwise(1)
    out = out.withColumn("rating", rating).withColumn("stage", F.when(c("has_channel"), "QUALIFIED").otherwise("NEW"))
    changed = all_failures([("rating", ~c("rating").eqNullSafe(c("old_rating"))), ("stage", ~c("stage").eqNullSafe(c("old_stage"))), ("area", F.trim(F.coalesce(c("service_area"), F.lit(""))) == "")])
    lacks = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) == ""
    out = out.withColumn("not_proposed", all_failures([(name, lacks(name)) for name in ("segment", "email", "website", "phone")]))
    out = out.withColumn("changes", changed)
    return out.withColumn("action", F.when(F.size("changes") > 0, "update").otherwise("noop"))


def missing_signals(df: DataFrame, as_of: str, area_cities: list[str]) -> Column:
    """Every signal that a company lacks, in order, not only the first."""
    c = F.col
    age = F.datediff(F.lit(as_of).cast("date"), c("verified_on"))
    rated = [t for types in catalog.LICENSE_RATING.values() for t in types]
    code = F.lpad(c("license_type"), F.greatest(F.lit(2), F.length("license_type")), F.lit("0"))
    return all_failures(
        [
            ("provenance", c("source_key").isNull() | c("source_url").isNull()),
            ("address", c("street").isNull() | c("city").isNull() | ~F.coalesce(c("zip").rlike(r"^\d{5}$"), F.lit(False))),
            ("service_area", ~F.coalesce(c("city").isin(area_cities), F.lit(False))),
            ("verification", age.isNull() | ~age.between(0, 30)),
            ("business_name", ~F.coalesce(c("business_name").rlike(r"[A-Za-z]{3}"), F.lit(False))),
            ("segment", ~F.coalesce(code.isin(rated), F.lit(False))),
        ]
    )
