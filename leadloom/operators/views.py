"""Leads, prospects, registers, sends and messages as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEADS_AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lead per order, with its customer's segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS id",
        "o_custkey AS customer",
        "o_orderdate AS created_at",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'commercial' ELSE 'residential' END AS segment",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'weekly' WHEN '2' THEN 'biweekly' WHEN '3' THEN 'monthly' WHEN '4' THEN 'daily' ELSE 'one_time' END AS frequency",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN element_at(array('office', 'retail', 'medical', 'restaurant', 'post_construction'), cast(o_custkey % 5 AS int) + 1) "
        "ELSE element_at(array('standard', 'deep', 'move', 'post_construction'), cast(o_orderkey % 4 AS int) + 1) END AS service_type",
        "o_orderkey % 7 AS bedrooms",
        "1 + o_orderkey % 4 AS bathrooms",
        "500 + (o_custkey % 40) * 250 AS sqft",
        "CASE WHEN o_orderkey % 2 = 0 THEN array(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'floor_wax' ELSE 'fridge' END, 'laundry', 'laundry', 'unknown') ELSE array() END AS addons",
        "CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'new' ELSE 'quoted' END AS status",
        "element_at(array('google', 'facebook', '', 'referral', 'yelp'), cast(o_custkey % 5 AS int) + 1) AS utm_source",
        "element_at(array('cpc', 'PPC', 'paid', 'Paid_Social', 'organic', 'email', '', 'organic', 'referral', 'organic', 'organic'), cast(o_orderkey % 11 AS int) + 1) AS utm_medium",
        "CASE WHEN o_orderkey % 29 = 0 THEN 'click' END AS gclid",
        "cast(90000 + o_custkey % 50 AS string) AS zip",
        "CASE WHEN o_orderkey % 3 <> 0 THEN concat('(619) 555-', lpad(cast(o_custkey % 10000 AS string), 4, '0')) END AS phone",
        "CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 19 = 0 THEN 'nodomain' ELSE concat('lead', o_custkey, CASE WHEN o_custkey % 3 = 0 THEN '@gmail.com' ELSE concat('@biz', o_custkey % 400, '.com') END) END AS email",
        "date_add(date '2001-07-25', cast(o_orderkey % 25 AS int)) AS preferred_date",
        "cast(o_orderkey % 80 AS int) AS message_length",
        "(90000 + o_custkey % 50) % 7 <> 0 AS in_area",
    )


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prospect per supplier; its business words come from the part of the same number."""
    s, n, p = (table(spark, sf_dir, t) for t in ("supplier", "nation", "part"))
    r = table(spark, sf_dir, "region")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(p, s.s_suppkey == p.p_partkey, "left")
    return joined.selectExpr(
        "s_suppkey AS id",
        "concat(coalesce(p_name, s_name), ' ', element_at(array('Dental Clinic', 'Bar and Grill', 'Property Management LLC', 'General Contractor Inc', 'Vacation Rental', 'Holdings'), cast(s_suppkey % 6 AS int) + 1)) AS business_name",
        "element_at(array('621210', '722511', '531312', '236118', '721199', '444110', ''), cast(s_suppkey % 7 AS int) + 1) AS naics",
        "CASE WHEN s_suppkey % 13 = 0 THEN 'permit_finaled' WHEN s_suppkey % 5 = 0 THEN 'new_business' ELSE 'active_permit' END AS signal_type",
        "cast(s_suppkey % 60 AS int) AS signal_days",
        "cast(91900 + s_suppkey % 300 AS string) AS zip",
        "r_name AS source",
        "n_name AS city",
        "s_acctbal AS balance",
        "CASE WHEN s_suppkey % 23 = 1 THEN 'owner@yahoo.co.uk' WHEN s_suppkey % 23 = 2 THEN 'me@proton.me' WHEN s_suppkey % 4 <> 0 THEN concat('info@site', s_suppkey % 50, '.com') ELSE '' END AS email",
        "CASE WHEN s_suppkey % 3 <> 0 THEN concat('619555', lpad(cast(s_suppkey % 10000 AS string), 4, '0')) ELSE '' END AS phone",
        "CASE WHEN s_suppkey % 4 = 1 THEN concat('https://www.Site', s_suppkey % 50, '.com/about') END AS website",
        "concat(s_suppkey % 900, ' Main St') AS address",
        "s_suppkey % 7 <> 0 AS in_area",
    )


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement events of leads: sent, opened, clicked, won, failed."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "ts", "user_id AS lead_id", "user_id % 25 AS domain", "value",
        "CASE event_type WHEN 'signup' THEN 'sent' WHEN 'view' THEN 'opened' WHEN 'click' THEN 'clicked' WHEN 'purchase' THEN 'won' ELSE 'failed' END AS kind",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", "text")
