"""Queries on records for other systems, and on gates and alerts of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads, views
from . import leads
from .leads import _LEADS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, and the DuckDB SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(_LEADS + "SELECT id, 'Service: ' || segment || ' · ' || service_type || ' · ' || frequency || chr(10) || 'Estimate: $' || quote_price || ' a visit' || CASE WHEN annual_value > 0 THEN ' · $' || annual_value || ' a year' ELSE '' END || chr(10) || 'Score: ' || score || '/100 (' || temperature || ')' || chr(10) || array_to_string(list_filter([CASE WHEN com THEN '  +25 commercial' END, CASE WHEN frequency IN ('weekly', 'daily') THEN '  +25 frequency' WHEN frequency = 'biweekly' THEN '  +20 frequency' WHEN frequency = 'monthly' THEN '  +14 frequency' END, CASE WHEN annual_value >= 10000 THEN '  +20 annual_value' WHEN annual_value >= 4000 THEN '  +13 annual_value' WHEN annual_value > 0 THEN '  +7 annual_value' END, CASE WHEN quote_price >= 400 THEN '  +10 price' WHEN quote_price >= 250 THEN '  +6 price' END, CASE WHEN phone IS NOT NULL THEN '  +10 phone' ELSE '  -5 phone' END, CASE WHEN days <= 3 THEN '  +15 preferred_date' WHEN days <= 7 THEN '  +10 preferred_date' WHEN days <= 14 THEN '  +5 preferred_date' END, CASE WHEN in_area THEN '  +8 area' ELSE '  -15 area' END, CASE WHEN com AND own_host THEN '  +7 business_mail' END, CASE WHEN msg > 40 THEN '  +5 message' END, CASE WHEN paid THEN '  +5 paid_click' END], lambda x: x IS NOT NULL)[1:6], chr(10)) AS description FROM scored")
def lead_description(spark, sf_dir):
    """PRJ-09 and PRJ-17."""
    p = payloads.lead_payload(leads.scored(spark, sf_dir))
    return p.select("id", payloads.describe(F.col("payload")).alias("description"))


@query(_LEADS + "SELECT id, concat_ws(',', 'all', segment, CASE WHEN temperature = 'hot' THEN 'hot' END) AS groups FROM scored")
def subscriber_groups(spark, sf_dir):
    s = leads.scored(spark, sf_dir)
    return s.select("id", F.array_join(payloads.subscriber_groups(F.col("segment"), F.col("temperature")), ",").alias("groups"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'unknown' WHEN s_suppkey % 8 = 0 THEN 'no_manifest' WHEN s_suppkey % 3 = 1 THEN 'robots_forbidden' WHEN s_suppkey % 3 = 2 THEN 'robots_unread' WHEN s_suppkey % 7 = 0 THEN 'not_eligible' WHEN s_suppkey % 5 = 0 THEN 'not_enabled' WHEN s_suppkey % 4 = 0 THEN 'not_implemented' WHEN s_suppkey % 13 = 4 THEN 'research_only' WHEN s_suppkey % 2 = 0 THEN 'attestation' END AS gate FROM supplier")
def source_gates(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "s_suppkey % 9 <> 0 AS known", "s_suppkey % 8 <> 0 AS has_manifest", "element_at(array('allowed', 'forbidden', 'unread'), cast(s_suppkey % 3 AS int) + 1) AS robots",
        "s_suppkey % 7 <> 0 AS eligible", "s_suppkey % 5 <> 0 AS enabled", "s_suppkey % 4 <> 0 AS implemented", "CASE WHEN s_suppkey % 13 = 4 THEN false WHEN s_suppkey % 2 = 1 THEN true END AS lead_use", "s_suppkey % 2 <> 0 AS attested",
    )
    return s.select("id", payloads.source_gate(s).alias("gate"))


@query("SELECT s_suppkey AS id, concat_ws(',', CASE WHEN s_suppkey % 11 = 0 THEN 'critical:crm_writes' END, CASE WHEN s_suppkey % 13 = 0 THEN 'critical:outbound' END, CASE WHEN s_suppkey % 4 = 0 THEN 'error:errors' END, CASE WHEN s_suppkey % 3 = 0 THEN 'warn:blocked' END, CASE WHEN s_suppkey % 5 = 0 THEN 'warn:no_candidates' END, CASE WHEN s_suppkey % 10 > 7 THEN 'warn:skip_ratio' END, CASE WHEN s_suppkey % 6 > 3 THEN 'warn:size_drift' END) AS alerts FROM supplier")
def run_alerts(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS crm_writes", "CASE WHEN s_suppkey % 13 = 0 THEN 2 ELSE 0 END AS outbound", "CASE WHEN s_suppkey % 4 = 0 THEN 3 ELSE 0 END AS errors",
        "CASE s_suppkey % 3 WHEN 0 THEN 'cursor' WHEN 1 THEN 'quota_24h' END AS blocked", "1000 AS fetched", "CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 20 END AS mapped", "CASE WHEN s_suppkey % 10 > 7 THEN 980 ELSE 900 END AS skipped",
        "100 + 10 * (s_suppkey % 6) + CASE WHEN s_suppkey % 6 > 3 THEN 50 ELSE 0 END AS bytes", "100 AS attested_bytes",
    )
    return s.select("id", F.array_join(payloads.run_alerts(s), ",").alias("alerts"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'missing:subject' WHEN p_size % 5 = 0 THEN 'missing:ask' WHEN p_size > 45 THEN 'subject_too_long' WHEN p_size % 3 = 0 THEN 'unfilled_placeholder' WHEN p_size % 2 = 0 AND length(split_part(p_name, ' ', 1)) > 3 THEN 'business_name_missing' END AS problem FROM part")
def copy_validation(spark, sf_dir):
    """CLS-28 on texts made of part names."""
    p = views.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS business", "CASE WHEN p_size % 7 = 0 THEN ' ' WHEN p_size > 45 THEN repeat('s', 91) ELSE 'hello' END AS subject", "CASE WHEN p_size % 3 = 0 THEN 'dear {{x}}' ELSE 'dear' END AS opener",
        "CASE WHEN p_size % 2 = 0 THEN '0' ELSE p_name END AS value", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'call' END AS ask",
    )
    c = F.col
    return p.select("id", payloads.copy_problem(c("subject"), c("opener"), c("value"), c("ask"), c("business")).alias("problem"))


@query("SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'outbound_enabled' END, CASE WHEN c_custkey % 3 = 0 THEN 'object_not_allowed' END, CASE WHEN c_custkey % 5 = 0 THEN 'operation_not_allowed' END, CASE WHEN c_custkey % 100 > 50 THEN 'over_cap' END, CASE WHEN c_custkey % 7 = 0 THEN 'source_disabled' END, CASE WHEN c_custkey % 4 = 1 THEN 'evidence_or_quota_expired' END, CASE WHEN c_custkey % 6 = 1 THEN 'staging_altered' END) AS refusals FROM customer")
def sync_refusals(spark, sf_dir):
    """CLS-32."""
    s = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_custkey % 2 = 0 AS outbound", "CASE WHEN c_custkey % 3 = 0 THEN array('companies', 'people') ELSE array('companies') END AS objects",
        "CASE WHEN c_custkey % 5 = 0 THEN array('create', 'update') ELSE array('create') END AS operations", "c_custkey % 100 AS largest_source",
        "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS disabled", "CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS stale", "CASE WHEN c_custkey % 6 = 1 THEN 1 ELSE 0 END AS invalid",
    )
    return s.select("id", F.array_join(payloads.refusals(s), ",").alias("refusals"))
