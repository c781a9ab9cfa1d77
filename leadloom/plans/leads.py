"""Queries on leads: quotes, scores, dashboards, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, money, text
from ..operators import kpi, pricing, scoring, views
from .chain import computed_once

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_LEADS = """WITH v_leads AS (
  SELECT o_orderkey AS id, o_custkey AS customer, o_orderdate AS created_at, c_mktsegment IN ('BUILDING', 'MACHINERY') AS com,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'commercial' ELSE 'residential' END AS segment,
    (['weekly', 'biweekly', 'monthly', 'daily', 'one_time'])[CAST(left(o_orderpriority, 1) AS INT)] AS frequency,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN (['office', 'retail', 'medical', 'restaurant', 'post_construction'])[o_custkey % 5 + 1]
      ELSE (['standard', 'deep', 'move', 'post_construction'])[o_orderkey % 4 + 1] END AS service_type,
    o_orderkey % 7 AS bed, 1 + o_orderkey % 4 AS bath, 500 + (o_custkey % 40) * 250 AS sqft, o_orderkey % 2 = 0 AS extras,
    CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'new' ELSE 'quoted' END AS status,
    (['google', 'facebook', '', 'referral', 'yelp'])[o_custkey % 5 + 1] AS utm_source, 
    (['cpc', 'PPC', 'paid', 'Paid_Social', 'organic', 'email', '', 'organic', 'referral', 'organic', 'organic'])[o_orderkey % 11 + 1] AS utm_medium, CASE WHEN o_orderkey % 29 = 0 THEN 'click' END AS gclid,
    lower(utm_medium) IN ('cpc', 'ppc', 'paid', 'paid_social') OR coalesce(gclid, '') <> '' AS paid,
    CAST(90000 + o_custkey % 50 AS VARCHAR) AS zip,
    CASE WHEN o_orderkey % 3 <> 0 THEN '(619) 555-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END AS phone,
    CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 19 = 0 THEN 'nodomain' ELSE 'lead' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN '@gmail.com' ELSE '@biz' || (o_custkey % 400) || '.com' END END AS email,
    coalesce(split_part(email, '@', 2), '') AS host, host IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com', 'icloud.com', 'aol.com', 'live.com', 'msn.com', 'proton.me', 'protonmail.com') AS free, host <> '' AND NOT free AS own_host, DATE '2001-07-25' + CAST(o_orderkey % 25 AS INT) AS preferred, o_orderkey % 80 AS msg, (90000 + o_custkey % 50) % 7 <> 0 AS in_area
  FROM orders JOIN customer ON o_custkey = c_custkey),
priced AS (SELECT *,
  CASE WHEN com THEN greatest(189.0::DOUBLE, (greatest(189.0::DOUBLE, 0.12::DOUBLE * sqft) * (CASE service_type WHEN 'retail' THEN 1.05 WHEN 'medical' THEN 1.35 WHEN 'restaurant' THEN 1.4 WHEN 'post_construction' THEN 1.8 ELSE 1.0 END)::DOUBLE
      + CASE WHEN extras THEN 250.0 ELSE 0.0 END) * (CASE frequency WHEN 'one_time' THEN 1.0 WHEN 'monthly' THEN 0.95 WHEN 'biweekly' THEN 0.9 WHEN 'daily' THEN 0.7 ELSE 0.82 END)::DOUBLE)
    ELSE greatest(129.0::DOUBLE, ((89 + 26 * bed + 34 * bath) * (CASE service_type WHEN 'deep' THEN 1.55 WHEN 'move' THEN 1.75 WHEN 'post_construction' THEN 2.1 ELSE 1.0 END)::DOUBLE
      + CASE WHEN extras THEN 60.0 ELSE 0.0 END) * (CASE frequency WHEN 'monthly' THEN 0.9 WHEN 'biweekly' THEN 0.85 WHEN 'weekly' THEN 0.8 ELSE 1.0 END)::DOUBLE) END AS total,
  (CASE frequency WHEN 'weekly' THEN 4.33 WHEN 'biweekly' THEN 2.17 WHEN 'monthly' THEN 1.0 WHEN 'daily' THEN CASE WHEN com THEN 21.7 ELSE 0.0 END ELSE 0.0 END)::DOUBLE AS visits,
  CASE WHEN com THEN greatest(2.0, floor(sqft / 1200::DOUBLE + 0.5)) ELSE floor(2 * (1.5::DOUBLE + 0.5::DOUBLE * bed + 0.6::DOUBLE * bath) * (CASE service_type WHEN 'deep' THEN 1.55 WHEN 'move' THEN 1.75 WHEN 'post_construction' THEN 2.1 ELSE 1.0 END)::DOUBLE + 0.5) / 2 END AS hours FROM v_leads),
quoted0 AS (SELECT *, CAST(floor(total / 5 + 0.5) * 5 AS BIGINT) AS quote_price FROM priced),
quoted AS (SELECT *, CAST(floor(quote_price * (1 - 0.12::DOUBLE) / 5 + 0.5) * 5 AS BIGINT) AS quote_low, CAST(floor(quote_price * (1 + 0.12::DOUBLE) / 5 + 0.5) * 5 AS BIGINT) AS quote_high,
  CAST(floor(quote_price * visits * 12 + 0.5) AS BIGINT) AS annual_value FROM quoted0),
scored0 AS (SELECT *, date_diff('day', DATE '2001-08-02', preferred) AS days FROM quoted),
scored1 AS (SELECT *, CAST(least(100, greatest(0, CASE WHEN com THEN 25 ELSE 0 END + CASE WHEN frequency IN ('weekly', 'daily') THEN 25 WHEN frequency = 'biweekly' THEN 20 WHEN frequency = 'monthly' THEN 14 ELSE 0 END
  + CASE WHEN annual_value >= 10000 THEN 20 WHEN annual_value >= 4000 THEN 13 WHEN annual_value > 0 THEN 7 ELSE 0 END + CASE WHEN quote_price >= 400 THEN 10 WHEN quote_price >= 250 THEN 6 ELSE 0 END
  + CASE WHEN phone IS NOT NULL THEN 10 ELSE -5 END + CASE WHEN days <= 3 THEN 15 WHEN days <= 7 THEN 10 WHEN days <= 14 THEN 5 ELSE 0 END + CASE WHEN in_area THEN 8 ELSE -15 END
  + CASE WHEN com AND own_host THEN 7 ELSE 0 END + CASE WHEN msg > 40 THEN 5 ELSE 0 END + CASE WHEN paid THEN 5 ELSE 0 END)) AS INT) AS score FROM scored0),
scored AS (SELECT *, CASE WHEN score >= 68 THEN 'hot' WHEN score >= 42 THEN 'warm' ELSE 'cold' END AS temperature FROM scored1)
"""


def query(oracle: str | None = None):
    """Register a query under its function's name, and the DuckDB SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = computed_once(pricing.with_quote(views.leads(spark, sf_dir)), "quote_price", "annual_value")
    return scoring.score_leads(quoted, views.LEADS_AS_OF)


@query(_LEADS + "SELECT segment, count(*) AS leads, sum(quote_price)::BIGINT AS pipeline, sum(annual_value)::BIGINT AS annual, floor(avg(score) + 0.5)::BIGINT AS avg_score, count(*) FILTER (status = 'won') AS won, count(*) FILTER (temperature = 'hot') AS hot FROM scored GROUP BY segment")
def lead_kpis_by_segment(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("segment").agg(
        F.count("*").alias("leads"), F.sum("quote_price").alias("pipeline"), F.sum("annual_value").alias("annual"), F.floor(F.avg("score") + 0.5).alias("avg_score"),
        F.count_if(F.col("status") == "won").alias("won"), F.count_if(F.col("temperature") == "hot").alias("hot"),
    )


@query(_LEADS + "SELECT id, quote_price, quote_low, quote_high, annual_value, hours FROM quoted")
def quotes(spark, sf_dir):
    return pricing.with_quote(views.leads(spark, sf_dir)).select("id", "quote_price", "quote_low", "quote_high", "annual_value", "hours")


@query(_LEADS + "SELECT id, score, temperature, concat_ws('|', CASE WHEN com THEN '25:commercial' END, CASE WHEN frequency IN ('weekly', 'daily') THEN '25:frequency' WHEN frequency = 'biweekly' THEN '20:frequency' WHEN frequency = 'monthly' THEN '14:frequency' END, CASE WHEN annual_value >= 10000 THEN '20:annual_value' WHEN annual_value >= 4000 THEN '13:annual_value' WHEN annual_value > 0 THEN '7:annual_value' END, CASE WHEN quote_price >= 400 THEN '10:price' WHEN quote_price >= 250 THEN '6:price' END, CASE WHEN phone IS NOT NULL THEN '10:phone' ELSE '-5:phone' END, CASE WHEN days <= 3 THEN '15:preferred_date' WHEN days <= 7 THEN '10:preferred_date' WHEN days <= 14 THEN '5:preferred_date' END, CASE WHEN in_area THEN '8:area' ELSE '-15:area' END, CASE WHEN com AND own_host THEN '7:business_mail' END, CASE WHEN msg > 40 THEN '5:message' END, CASE WHEN paid THEN '5:paid_click' END) AS reasons FROM scored")
def lead_score_reasons(spark, sf_dir):
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["points"].cast("string"), r["reason"])), "|")
    return scored(spark, sf_dir).select("id", "score", "temperature", reasons.alias("reasons"))


@query(_LEADS + ", recent AS (SELECT * FROM scored WHERE created_at >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY) SELECT count(*) AS leads, coalesce(sum(quote_price), 0)::BIGINT AS pipeline, coalesce(sum(annual_value), 0)::BIGINT AS annual, floor(coalesce(avg(score), 0) + 0.5)::BIGINT AS avg_score, count(*) FILTER (status = 'won') AS won, coalesce(sum(CASE WHEN status = 'won' THEN quote_price END), 0)::BIGINT AS revenue, CASE WHEN count(*) > 0 THEN floor((count(*) FILTER (status = 'won'))::DOUBLE / count(*) * 1000 + 0.5) / 10 ELSE 0.0 END AS conversion FROM recent")
def kpi_totals(spark, sf_dir):
    return kpi.totals(kpi.since(scored(spark, sf_dir), "created_at", views.LEADS_AS_OF, 400))


@query(_LEADS + "SELECT status, count(*) AS n FROM v_leads GROUP BY status")
def by_status(spark, sf_dir):
    return kpi.counts(views.leads(spark, sf_dir), "status")


@query(_LEADS + "SELECT temperature, count(*) AS n FROM scored GROUP BY temperature")
def by_temperature(spark, sf_dir):
    return kpi.counts(scored(spark, sf_dir), "temperature")


@query(_LEADS + "SELECT coalesce(nullif(trim(utm_source), ''), 'direct') AS source, count(*) AS n, sum(quote_price)::BIGINT AS pipeline FROM quoted GROUP BY 1 ORDER BY n DESC, source LIMIT 12")
def by_source_top12(spark, sf_dir):
    df = pricing.with_quote(views.leads(spark, sf_dir)).withColumn("source", kpi.traffic_source(F.col("utm_source")))
    return kpi.top(kpi.counts(df, "source", pipeline="quote_price"), 12, F.desc("n"), F.col("source"))


@query(_LEADS + "SELECT segment, service_type, count(*) AS n FROM v_leads GROUP BY ALL")
def by_service(spark, sf_dir):
    return kpi.counts(views.leads(spark, sf_dir), "segment", "service_type")


@query(_LEADS + "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM v_leads WHERE created_at >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY GROUP BY 1")
def daily_counts(spark, sf_dir):
    return kpi.counts(kpi.since(views.leads(spark, sf_dir), "created_at", views.LEADS_AS_OF, 90).withColumn("day", F.to_date("created_at")), "day")


@query(_LEADS + ", hits AS (SELECT * FROM scored WHERE status = 'new' AND segment = 'commercial' AND (email ILIKE '%biz1%' OR zip ILIKE '%biz1%' OR coalesce(phone, '') ILIKE '%biz1%')) SELECT id, email, score, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY score DESC, created_at DESC, id LIMIT 50 OFFSET 10")
def lead_search_page(spark, sf_dir):
    return kpi.search(scored(spark, sf_dir), status="new", segment="commercial", text="biz1", limit=50, offset=10).select("id", "email", "score", "total")


@query("SELECT sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)::BIGINT AS sent, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS opened, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicked, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed FROM events")
def engagement_rates(spark, sf_dir):
    return kpi.engagement(views.sends(spark, sf_dir))


@query(_LEADS + "SELECT segment, temperature, count(*) AS n, grouping_id(segment, temperature)::BIGINT AS level FROM scored GROUP BY ROLLUP (segment, temperature)")
def reason_rollup(spark, sf_dir):
    return scored(spark, sf_dir).rollup("segment", "temperature").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(_LEADS + "SELECT id, CASE WHEN phone IS NULL THEN '' ELSE '+1' || regexp_replace(phone, '[^0-9]', '', 'g') END AS phone, CASE WHEN NOT regexp_matches(coalesce(email, ''), '^[^\\s@]+@[^\\s@]+\\.[a-z]{2,}$') THEN 'invalid' ELSE 'valid' END AS email_status, host AS domain, free AS free_mail, '$' || format('{:,}', quote_price) AS price_text FROM quoted")
def contact_normalized(spark, sf_dir):
    return pricing.with_quote(views.leads(spark, sf_dir)).select(
        "id", contact.phone(F.col("phone")).alias("phone"), contact.email_status(F.col("email")).alias("email_status"), contact.email_domain(F.col("email")).alias("domain"),
        contact.free_mail(F.col("email")).alias("free_mail"), money.dollars(F.col("quote_price")).alias("price_text"),
    )


@query(_LEADS + "SELECT least(5, CAST(floor(score / 20.0) AS INT) + 1) AS bucket, count(*) AS n FROM scored GROUP BY 1")
def rating_bucket(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.least(F.lit(5), F.floor(F.col("score") / 20).cast("int") + 1).alias("bucket")).agg(F.count("*").alias("n"))


@query(_LEADS + "SELECT segment, service_type, frequency, count(*) AS n, sum(quote_price)::BIGINT AS pipeline FROM quoted GROUP BY CUBE (segment, service_type, frequency)")
def pipeline_cube(spark, sf_dir):
    return pricing.with_quote(views.leads(spark, sf_dir)).cube("segment", "service_type", "frequency").agg(F.count("*").alias("n"), F.sum("quote_price").alias("pipeline"))


@query(_LEADS + "SELECT customer, count(*) AS n_leads, string_agg(id || ':' || status || ':' || quote_price, ',' ORDER BY created_at DESC, id) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY created_at DESC, id) AS rn FROM quoted) WHERE rn <= 50 GROUP BY customer")
def lead_detail_nested(spark, sf_dir):
    """JN-04: each customer's latest 50 leads, newest first; a row number bounds what is gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy("customer").orderBy(F.desc("created_at"), "id")
    ranked = pricing.with_quote(views.leads(spark, sf_dir)).withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    items = F.sort_array(F.collect_list(F.struct("rn", F.concat_ws(":", F.col("id").cast("string"), "status", F.col("quote_price").cast("string")).alias("t"))))
    return ranked.groupBy("customer").agg(F.count("*").alias("n_leads"), F.array_join(F.transform(items, lambda x: x["t"]), ",").alias("latest"))


@query(_LEADS + "SELECT id, concat_ws(' · ', email, segment, service_type) AS label, '…' || right(CAST(id + 100000000 AS VARCHAR), 8) AS masked, CASE WHEN annual_value > 0 THEN annual_value ELSE quote_price END * 1000000 AS amount_micros FROM quoted")
def opportunity_projection(spark, sf_dir):
    """PRJ-08, PRJ-15, PRJ-16."""
    amount = F.when(F.col("annual_value") > 0, F.col("annual_value")).otherwise(F.col("quote_price")) * F.lit(1000000)
    return pricing.with_quote(views.leads(spark, sf_dir)).select(
        "id", F.concat_ws(" · ", "email", "segment", "service_type").alias("label"), text.masked_id(F.col("id") + 100000000).alias("masked"), amount.cast("long").alias("amount_micros")
    )
