"""Queries on prospects: segments, keys, verdicts, resolution, guards and change plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, keys, text
from ..operators import guards, kpi, pricing, resolve, scoring, segments, views
from ..plans import catalog, chain

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


_PROSPECTS = """WITH v_prospects AS (
  SELECT s_suppkey AS id, coalesce(p_name, s_name) || ' ' || (['Dental Clinic', 'Bar and Grill', 'Property Management LLC', 'General Contractor Inc', 'Vacation Rental', 'Holdings'])[s_suppkey % 6 + 1] AS business_name,
    (['621210', '722511', '531312', '236118', '721199', '444110', ''])[s_suppkey % 7 + 1] AS naics,
    CASE WHEN s_suppkey % 13 = 0 THEN 'permit_finaled' WHEN s_suppkey % 5 = 0 THEN 'new_business' ELSE 'active_permit' END AS signal_type,
    s_suppkey % 60 AS signal_days, CAST(91900 + s_suppkey % 300 AS VARCHAR) AS zip, r_name AS source, n_name AS city,
    CASE WHEN s_suppkey % 23 = 1 THEN 'owner@yahoo.co.uk' WHEN s_suppkey % 23 = 2 THEN 'me@proton.me' WHEN s_suppkey % 4 <> 0 THEN 'info@site' || (s_suppkey % 50) || '.com' ELSE '' END AS email,
    CASE WHEN s_suppkey % 3 <> 0 THEN '619555' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') ELSE '' END AS phone,
    CASE WHEN s_suppkey % 4 = 1 THEN 'https://www.Site' || (s_suppkey % 50) || '.com/about' END AS website, (s_suppkey % 900) || ' Main St' AS address, s_suppkey % 7 <> 0 AS in_area
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON s_suppkey = p_partkey),
"""


def _classify_sql() -> str:
    rows = ", ".join(f"({k}, '{name}', {list(words)}, {list(codes)})" for k, (name, (_, words, codes)) in enumerate(catalog.SEGMENTS.items()))
    return (
        _PROSPECTS
        + f"""cat(ord, segment, kw, codes) AS (VALUES {rows}),
hits AS (SELECT p.id, ord, segment, len(list_filter(kw, lambda k: contains(lower(strip_accents(business_name)), k))) * 2 + CASE WHEN naics = '' THEN 0 WHEN list_contains(codes, naics) THEN 4
  WHEN len(list_filter(codes, lambda c: left(c, 4) = left(naics, 4))) > 0 THEN 2 ELSE 0 END AS score FROM v_prospects p, cat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rn, lead(score) OVER (PARTITION BY id ORDER BY score DESC, ord) AS second FROM hits),
best AS (SELECT p.*, CASE WHEN signal_type = 'permit_finaled' THEN 'post_construction' WHEN score > 0 THEN segment END AS segment,
  CASE WHEN signal_type = 'permit_finaled' THEN 0.9::DOUBLE WHEN score > 0 THEN floor(least(1.0::DOUBLE, score / 6.0::DOUBLE * CASE WHEN score > second THEN 1.0 ELSE 0.6 END::DOUBLE) * 100 + 0.5) / 100 ELSE 0.0 END AS confidence
  FROM v_prospects p JOIN ranked r ON p.id = r.id AND rn = 1)
"""
    )


_BEST = _classify_sql()


def classified(spark, sf_dir):
    return segments.with_segment(views.prospects(spark, sf_dir), F.col("business_name"), F.col("naics"), F.col("signal_type"))


@query(_BEST + "SELECT id, segment, confidence FROM best")
def icp_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("id", "segment", "confidence")


@query(
    _PROSPECTS
    + "k AS (SELECT id, lower(business_name) AS n, lower(address) AS a, * EXCLUDE (id) FROM v_prospects) SELECT id, regexp_replace(regexp_replace(n, '\\b(inc|llc|corp|co|ltd|the|a|and|de|del|la|el)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS key_a, regexp_replace(regexp_replace(n, '\\b(inc|llc|corp|corporation|company|co|ltd|lp|the|and|de|del|la|el|dba)\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS key_b, regexp_replace(regexp_replace(n, '\\b(inc|llc|corp|corporation|company|co|ltd|lp|the|and|de|del|la|el|dba)\\b', '', 'g'), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(a, '[^a-z0-9]', '', 'g') AS cross_key FROM k"
)
def name_keys(spark, sf_dir):
    return views.prospects(spark, sf_dir).select(
        "id", keys.name_key_a(F.col("business_name")).alias("key_a"), keys.name_key_b(F.col("business_name")).alias("key_b"), keys.cross_key(F.col("business_name"), F.col("address")).alias("cross_key")
    )


@query(
    _PROSPECTS
    + "k AS (SELECT *, regexp_replace(regexp_replace(lower(business_name), '\\b(inc|llc|corp|co|ltd|the|a|and|de|del|la|el)\\b', '', 'g'), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(address), '[^a-z0-9]', '', 'g') || '|' || left(zip, 5) AS basis FROM v_prospects) SELECT id, CASE WHEN website IS NOT NULL THEN 'web:' || regexp_replace(lower(regexp_extract(website, '^https?://([^/]+)', 1)), '^www\\.', '') WHEN length(phone) >= 10 THEN 'tel:' || right(phone, 10) ELSE 'name:' || left(sha1(basis), 20) END AS dedupe_key FROM k"
)
def dedupe_keys(spark, sf_dir):
    c = F.col
    key = keys.dedupe_key(F.lit(None).cast("string"), c("business_name"), c("address"), c("zip"), c("website"), c("phone"))
    return views.prospects(spark, sf_dir).select("id", key.alias("dedupe_key"))


_JOBS = "jobs(segment, price, annual) AS (VALUES ('property_manager', 245, 12730), ('office_clinic', 395, 20524), ('restaurant_retail', 295, 76818), ('str_host', 140, 7274), ('post_construction', 650, 0))"
_SCORED = (
    _BEST
    + f", {_JOBS}, valued AS (SELECT b.*, j.price AS visit_value, j.annual AS annual_value FROM best b LEFT JOIN jobs j USING (segment)), "
    + """icp AS (SELECT *, CAST(least(100, greatest(0, CASE segment WHEN 'property_manager' THEN 30 WHEN 'office_clinic' THEN 26 WHEN 'post_construction' THEN 24 WHEN 'restaurant_retail' THEN 22 WHEN 'str_host' THEN 20 ELSE 0 END
  + CASE WHEN annual_value >= 20000 THEN 22 WHEN annual_value >= 8000 THEN 15 WHEN annual_value > 0 THEN 8 WHEN visit_value >= 500 THEN 10 ELSE 0 END
  + CASE WHEN signal_type = 'permit_finaled' AND signal_days <= 14 THEN 20 WHEN signal_type = 'permit_finaled' AND signal_days <= 45 THEN 10 ELSE 0 END
  + CASE WHEN signal_type = 'new_business' AND signal_days <= 60 THEN 14 ELSE 0 END + CASE WHEN email <> '' AND NOT regexp_matches(lower(email), '@(gmail|yahoo|hotmail|outlook|aol|icloud|live|msn)\\.') THEN 8 ELSE 0 END + CASE WHEN phone <> '' THEN 5 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 5 ELSE 0 END
  + CASE WHEN in_area THEN 8 ELSE -25 END + CASE WHEN confidence < 0.4 THEN -8 ELSE 0 END)) AS INT) AS icp_score FROM valued)
"""
)


def priced_segments(spark):
    """segment, visit_value, annual_value: each segment's job, priced by the quote operator."""
    rows = F.array(*[F.struct(F.lit(s).alias("name"), F.lit(j[0]).alias("segment"), F.lit(j[1]).alias("service_type"), F.lit(j[2]).alias("frequency"), F.lit(j[3]).alias("bedrooms"), F.lit(j[4]).alias("bathrooms"), F.lit(j[5]).alias("sqft")) for s, j in catalog.SEGMENT_JOBS.items()])
    jobs = spark.range(1).select(F.inline(rows)).withColumn("addons", F.array().cast("array<string>"))
    return pricing.with_quote(jobs).select(F.col("name").alias("segment"), F.col("quote_price").alias("visit_value"), "annual_value", "quote_low", "quote_high")


@query(
    _SCORED
    + ", ranges(segment, low, high) AS (VALUES ('property_manager', 215, 275), ('office_clinic', 350, 440), ('restaurant_retail', 260, 330), ('str_host', 125, 155), ('post_construction', 570, 730)),"
    " held AS (SELECT segment, count(*) AS prospects FROM icp GROUP BY 1) SELECT segment, price::BIGINT AS visit_value, annual::BIGINT AS annual_value, low::BIGINT AS quote_low, high::BIGINT AS quote_high, coalesce(prospects, 0) AS prospects FROM jobs JOIN ranges USING (segment) LEFT JOIN held USING (segment)"
)
def segment_quote_dim(spark, sf_dir):
    """JN-21: the dimension of priced segments, each with the number of prospects that refer to it."""
    held = classified(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("prospects"))
    return priced_segments(spark).join(held, "segment", "left").withColumn("prospects", F.coalesce("prospects", F.lit(0)))


def scored(spark, sf_dir):
    p = classified(spark, sf_dir).join(F.broadcast(priced_segments(spark).select("segment", "visit_value", "annual_value")), "segment", "left")
    return scoring.score_prospects(p.withColumn("valuation", F.lit(None).cast("double")))


@query(_SCORED + "SELECT id, icp_score FROM icp")
def prospect_score(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "icp_score")


def suppression(spark, sf_dir):
    n = views.table(spark, sf_dir, "supplier")
    mails = n.where("s_suppkey % 10 = 1").selectExpr("'email' AS kind", "concat('INFO@site', s_suppkey % 50, '.com') AS value")
    return mails.union(n.where("s_suppkey % 50 = 3").selectExpr("'domain' AS kind", "concat('site', s_suppkey % 50, '.com') AS value")).distinct()


_SUPP = ", sup AS (SELECT DISTINCT * FROM (SELECT 'email' AS kind, lower('INFO@site' || (s_suppkey % 50) || '.com') AS value FROM supplier WHERE s_suppkey % 10 = 1 UNION ALL SELECT 'domain', 'site' || (s_suppkey % 50) || '.com' FROM supplier WHERE s_suppkey % 50 = 3)), marked AS (SELECT i.*, CASE WHEN email = '' THEN 'no_email' WHEN lower(email) IN (SELECT value FROM sup WHERE kind = 'email') THEN 'email' WHEN split_part(lower(email), '@', 2) IN (SELECT value FROM sup WHERE kind = 'domain') THEN 'domain' END AS suppressed_by FROM icp i)"


@query(_SCORED + _SUPP + "SELECT id, suppressed_by FROM marked")
def suppression_semi(spark, sf_dir):
    return guards.suppressed_by(scored(spark, sf_dir), suppression(spark, sf_dir)).select("id", "suppressed_by")


_VERDICT = (
    _SCORED
    + _SUPP
    + ", verdicts AS (SELECT m.*, CASE WHEN email = '' THEN 'no_email' WHEN NOT in_area THEN 'out_of_service_area' WHEN suppressed_by IS NOT NULL THEN 'suppressed' WHEN u.user_id IS NOT NULL THEN 'previously_unsubscribed' WHEN l.c_custkey IS NOT NULL THEN 'already_a_lead:' || l.status WHEN icp_score < 45 THEN 'below_threshold' ELSE 'qualified' END AS verdict FROM marked m LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 180) u ON u.user_id = m.id LEFT JOIN (SELECT o_custkey AS c_custkey, arg_min(CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'new' ELSE 'quoted' END, o_orderkey) AS status FROM orders WHERE o_custkey % 9 = 2 GROUP BY 1) l ON l.c_custkey = m.id)"
)


def verdicts(spark, sf_dir):
    p = guards.suppressed_by(scored(spark, sf_dir), suppression(spark, sf_dir))
    bad = views.table(spark, sf_dir, "events").where("event_type = 'error' AND value > 180").select(F.col("user_id").alias("id")).distinct().withColumn("unsubscribed", F.lit(True))
    known = views.leads(spark, sf_dir).where("customer % 9 = 2").groupBy(F.col("customer").alias("id")).agg(F.min_by("status", "id").alias("lead_status"))
    p = p.join(bad, "id", "left").join(known, "id", "left").withColumn("unsubscribed", F.coalesce("unsubscribed", F.lit(False)))
    return p.withColumn("verdict", scoring.prospect_verdict(p))


@query(_VERDICT + "SELECT id, verdict FROM verdicts")
def prospect_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).select("id", "verdict")


@query(_VERDICT + "SELECT split_part(verdict, ':', 1) AS reason, count(*) AS n FROM verdicts GROUP BY 1 ORDER BY n DESC, reason LIMIT 12")
def reject_histogram(spark, sf_dir):
    return kpi.reject_reasons(verdicts(spark, sf_dir))


@query(_VERDICT + "SELECT CASE WHEN verdict = 'qualified' THEN 'qualified' ELSE 'rejected' END AS stage, count(*) AS n FROM verdicts GROUP BY 1")
def funnel_by_stage(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy(F.when(F.col("verdict") == "qualified", "qualified").otherwise("rejected").alias("stage")).agg(F.count("*").alias("n"))


@query(_VERDICT + "SELECT segment, count(*) AS n, coalesce(sum(annual_value), 0)::BIGINT AS annual FROM verdicts WHERE verdict = 'qualified' GROUP BY segment")
def segment_value(spark, sf_dir):
    return kpi.counts(verdicts(spark, sf_dir).where("verdict = 'qualified'"), "segment", annual="annual_value")


@query(_VERDICT + "SELECT source, count(*) AS n, count(*) FILTER (verdict = 'qualified') AS qualified FROM verdicts GROUP BY source")
def source_conversion(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "qualified").alias("qualified"))


@query(_PROSPECTS + "x AS (SELECT id, naics, TRY_CAST(left(naics, 2) AS INT) AS sector FROM v_prospects) SELECT id, sector, CASE WHEN sector = 23 THEN 'post_construction' WHEN sector IN (42, 44, 45) THEN 'retail' WHEN sector = 53 THEN 'property_managers' WHEN sector = 72 THEN 'restaurants' WHEN sector IN (54, 55, 56, 62, 71, 81) THEN 'offices' END AS sector_segment FROM x")
def sector_filter(spark, sf_dir):
    return views.prospects(spark, sf_dir).select("id", segments.sector(F.col("naics")).alias("sector"), segments.sector_segment(F.col("naics")).alias("sector_segment"))


@query(_PROSPECTS + "z AS (SELECT id, CAST(zip AS INT) AS z FROM v_prospects) SELECT id, z BETWEEN 91901 AND 91987 OR z BETWEEN 92003 AND 92199 AS inside FROM z")
def zip_ranges(spark, sf_dir):
    return views.prospects(spark, sf_dir).select("id", contact.zip_in_ranges(F.col("zip"), catalog.COUNTY_ZIP_RANGES).alias("inside"))


_RANKED = _PROSPECTS + "c AS (SELECT id, (['schools', 'licenses', 'permits', 'multifamily'])[id % 4 + 1] AS source, CASE WHEN id % 17 <> 0 THEN 'n' || (id % 37) END AS name_key FROM v_prospects)"


def candidates(spark, sf_dir):
    return views.prospects(spark, sf_dir).selectExpr("id", "element_at(array('schools', 'licenses', 'permits', 'multifamily'), cast(id % 4 AS int) + 1) AS source", "CASE WHEN id % 17 <> 0 THEN concat('n', id % 37) END AS name_key")


def claimed(spark, sf_dir):
    order = chain.case_map(F.col("source"), {s: k for k, s in enumerate(catalog.SOURCE_PRIORITY)}, 99)
    return resolve.claims(candidates(spark, sf_dir), "name_key", order, F.col("id"))


@query(_RANKED + ", p AS (SELECT *, list_position(['schools', 'licenses', 'permits', 'multifamily'], source) AS pr FROM c) SELECT id, source, CASE WHEN name_key IS NULL THEN source ELSE first_value(source) OVER w END AS winner, name_key IS NULL OR row_number() OVER w = 1 AS claimed FROM p WINDOW w AS (PARTITION BY name_key ORDER BY pr, id)")
def cross_source_claim(spark, sf_dir):
    return claimed(spark, sf_dir).select("id", "source", "winner", "claimed")


@query(_RANKED + ", p AS (SELECT *, list_position(['schools', 'licenses', 'permits', 'multifamily'], source) AS pr FROM c), r AS (SELECT source, name_key IS NULL OR row_number() OVER (PARTITION BY name_key ORDER BY pr, id) = 1 AS claimed FROM p) SELECT source, count(*) AS fetched, count(*) FILTER (claimed) AS created, count(*) FILTER (NOT claimed) AS deduped, count(*) = count(*) FILTER (claimed) + count(*) FILTER (NOT claimed) AS conserved FROM r GROUP BY ROLLUP (source)")
def reconcile_totals(spark, sf_dir):
    n, made, gone = F.count("*"), F.count_if("claimed"), F.count_if(~F.col("claimed"))
    return claimed(spark, sf_dir).rollup("source").agg(n.alias("fetched"), made.alias("created"), gone.alias("deduped"), (n == made + gone).alias("conserved"))


@query(_RANKED + " SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND 'n' || c_custkey = name_key) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey * 5 = c.id)")
def index_anti_or(spark, sf_dir):
    index = views.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("concat('n', c_custkey) AS name_key", "c_custkey * 5 AS id")
    return resolve.not_known(candidates(spark, sf_dir), index, ["name_key", "id"]).select("id")


_REGISTER = "WITH r AS (SELECT p_partkey AS id, p_brand AS entity, DATE '2001-01-01' + CAST(p_size AS INT) AS issued FROM part)"


def register(spark, sf_dir):
    return views.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS entity", "date_add(date '2001-01-01', p_size) AS issued", "p_type AS type", "p_name AS name", "p_retailprice AS valuation")


@query(_REGISTER + " SELECT entity, arg_max(id, (issued, -id)) AS id, max(issued) AS issued FROM r GROUP BY entity ORDER BY issued DESC, id LIMIT 50")
def latest_per_entity(spark, sf_dir):
    best = resolve.best_per_entity(register(spark, sf_dir).select("entity", "id", "issued"), ["entity"], F.struct("issued", -F.col("id")))
    return resolve.capped(best, 50, F.desc("issued"), F.col("id"))


@query(_REGISTER + " SELECT entity, min(id) AS id FROM r GROUP BY entity ORDER BY id LIMIT 50")
def min_id_per_entity(spark, sf_dir):
    best = resolve.best_per_entity(register(spark, sf_dir).select("entity", "id"), ["entity"], -F.col("id"))
    return resolve.capped(best, 50, F.col("id"))


@query(_REGISTER + ", d AS (SELECT *, row_number() OVER (PARTITION BY entity, issued ORDER BY id) > 1 AS duplicate FROM r) SELECT duplicate, count(*) AS n FROM d GROUP BY duplicate")
def first_wins(spark, sf_dir):
    return resolve.first_wins(register(spark, sf_dir), ["entity", "issued"], F.col("id")).groupBy("duplicate").agg(F.count("*").alias("n"))


_CHANGES = "WITH old AS (SELECT c_custkey AS id, c_mktsegment AS seg, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 40 = 1), new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation FROM customer WHERE c_custkey % 7 <> 0)"


def _old_new(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS id", "c_mktsegment AS seg", "CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation")
    again = c.where("c_custkey % 40 = 1").selectExpr("c_custkey AS id", "c_mktsegment AS seg", "c_nationkey AS nation")
    new = c.where("c_custkey % 7 <> 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg", "CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation")
    return old, old.union(again), new


@query(_CHANGES + ", o AS (SELECT id, count(*) AS m, min(seg) AS seg, min(nation) AS nation FROM old GROUP BY id) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'orphan' WHEN m > 1 THEN 'ambiguous' WHEN o.id IS NULL THEN 'create' WHEN o.seg IS DISTINCT FROM n.seg OR o.nation IS DISTINCT FROM n.nation THEN 'update' ELSE 'noop' END AS action, CASE WHEN n.id IS NOT NULL AND m = 1 THEN concat_ws(',', CASE WHEN o.seg IS DISTINCT FROM n.seg THEN 'seg' END, CASE WHEN o.nation IS DISTINCT FROM n.nation THEN 'nation' END) ELSE '' END AS changed FROM o FULL JOIN new n ON o.id = n.id")
def plan_diff(spark, sf_dir):
    _, old, new = _old_new(spark, sf_dir)
    return resolve.plan_changes(old, new, "id", ["seg", "nation"])


@query(_CHANGES + ", k AS (SELECT id FROM new UNION SELECT id FROM old WHERE id % 4 <> 0) SELECT CASE WHEN id % 7 <> 0 THEN 'noop' ELSE 'orphan' END AS action, count(*) AS n FROM k GROUP BY 1")
def replan_noop(spark, sf_dir):
    """Once the plan is applied, the next one changes nothing."""
    old, _, new = _old_new(spark, sf_dir)
    after = resolve.apply_plan(old, new, "id", ["seg", "nation"])
    return resolve.plan_changes(after, new, "id", ["seg", "nation"]).groupBy("action").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN o.n > 1 THEN 'AMBIGUOUS' WHEN o.n = 1 THEN 'FOUND' ELSE 'MISSING' END AS status FROM customer LEFT JOIN o ON c_custkey = o.id")
def ambiguous_key(spark, sf_dir):
    n = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    j = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left")
    return j.select("id", F.when(F.col("n") > 1, "AMBIGUOUS").when(F.col("n") == 1, "FOUND").otherwise("MISSING").alias("status"))


@query(_PROSPECTS + "e AS (SELECT id, phone <> '' AS ch, in_area, signal_type <> 'active_permit' AS official, id % 900 <> 0 AS adr, id % 4 + 1 AS old_rating, CASE WHEN id % 2 = 0 THEN 'NEW' ELSE 'QUALIFIED' END AS old_stage, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'San Diego' ELSE NULL END AS old_area, email, website, phone FROM v_prospects), s AS (SELECT *, CASE WHEN ch THEN 25 ELSE 0 END + CASE WHEN in_area THEN 15 ELSE 0 END + CASE WHEN official THEN 10 ELSE 0 END + CASE WHEN adr THEN 10 ELSE 0 END AS plan_score FROM e), r AS (SELECT *, CASE WHEN plan_score >= 70 THEN 4 WHEN plan_score >= 50 THEN 3 WHEN plan_score >= 30 THEN 2 ELSE 1 END AS rating, CASE WHEN ch THEN 'QUALIFIED' ELSE 'NEW' END AS stage FROM s) SELECT id, plan_score::INT AS plan_score, rating::INT AS rating, stage, concat_ws(',', CASE WHEN rating <> old_rating THEN 'rating' END, CASE WHEN stage <> old_stage THEN 'stage' END, CASE WHEN coalesce(old_area, '') = '' THEN 'area' END) AS changes, CASE WHEN rating <> old_rating OR stage <> old_stage OR coalesce(old_area, '') = '' THEN 'update' ELSE 'noop' END AS action FROM r")
def enrich_plan(spark, sf_dir):
    p = views.prospects(spark, sf_dir).selectExpr("id", "phone <> '' AS has_channel", "in_area", "signal_type <> 'active_permit' AS official", "id % 900 <> 0 AS has_address", "cast(id % 4 + 1 AS int) AS old_rating", "CASE WHEN id % 2 = 0 THEN 'NEW' ELSE 'QUALIFIED' END AS old_stage", "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'San Diego' END AS service_area", "CASE WHEN id % 5 > 0 THEN 'office' END AS segment", "email", "website", "phone")
    return scoring.enrichment_plan(p).select("id", "plan_score", "rating", "stage", F.array_join("changes", ",").alias("changes"), "action")


_SIGNALS = _PROSPECTS + "q AS (SELECT id, id % 6 = 0 AS no_source, id % 900 AS no, city IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7', 'NATION_8') AS in_city, id % 45 AS age, business_name, list_contains(['41', '47', '75', '42', '48', '61', '50', '51', '52', '57', '70', '90', '20', '21', '49', '59', '60'], lpad(CAST(id % 80 AS VARCHAR), 2, '0')) AS rated FROM v_prospects), m AS (SELECT id, list_filter([CASE WHEN no_source THEN 'provenance' END, CASE WHEN no = 0 THEN 'address' END, CASE WHEN NOT in_city THEN 'service_area' END, CASE WHEN age > 30 THEN 'verification' END, CASE WHEN NOT regexp_matches(business_name, '[A-Za-z]{3}') THEN 'business_name' END, CASE WHEN NOT rated THEN 'segment' END], lambda x: x IS NOT NULL) AS missing FROM q)"


def _missing(spark, sf_dir):
    p = views.prospects(spark, sf_dir).selectExpr(
        "id", "CASE WHEN id % 6 <> 0 THEN 'key' END AS source_key", "'u' AS source_url", "CASE WHEN id % 900 <> 0 THEN address END AS street", "city", "zip", "business_name", "date_sub(date '2024-01-31', cast(id % 45 AS int)) AS verified_on", "cast(id % 80 AS string) AS license_type"
    )
    return p.withColumn("missing", scoring.missing_signals(p, "2024-01-31", [f"NATION_{k}" for k in range(1, 9)]))


@query(_SIGNALS + " SELECT id, array_to_string(missing, ',') AS missing FROM m")
def qualification_missing(spark, sf_dir):
    return _missing(spark, sf_dir).select("id", F.array_join("missing", ",").alias("missing"))


@query(_SIGNALS + ", e AS (SELECT unnest(CASE WHEN len(missing) = 0 THEN ['segment'] ELSE missing END) AS signal FROM m WHERE len(missing) > 0 OR id % 10 = 3) SELECT signal, count(*) AS n FROM e GROUP BY signal")
def missing_histogram(spark, sf_dir):
    """AGG-22: unqualified companies by each signal they lack; one that lacks none and was refused all the same lacks a segment."""
    each = F.explode(F.when(F.size("missing") == 0, F.array(F.lit("segment"))).otherwise(F.col("missing")))
    unqualified = _missing(spark, sf_dir).where((F.size("missing") > 0) | (F.col("id") % 10 == 3))
    return unqualified.select(each.alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


@query(_PROSPECTS + "w AS (SELECT id, business_name, lower(regexp_replace(business_name, '\\b(Inc|LLC|and)\\b', ' ', 'g')) AS n FROM v_prospects), l AS (SELECT id, business_name, list_filter(string_split_regex(n, '\\s+'), lambda x: x <> '') AS ws FROM w), c AS (SELECT id, list_filter([array_to_string(ws, ''), array_to_string(ws, '-'), array_to_string(ws[1:2], '')], lambda x: length(x) BETWEEN 4 AND 40) AS names FROM l) SELECT id, array_to_string(flatten(list_transform(names, lambda x: [x || '.com', x || '.net'])), ',') AS domains FROM c")
def domain_candidates(spark, sf_dir):
    return views.prospects(spark, sf_dir).select("id", F.array_join(contact.domain_candidates(F.col("business_name")), ",").alias("domains"))


_MAPPED = "WITH r AS (SELECT p_partkey AS id, p_type, p_brand, p_size, p_name, p_retailprice FROM part), k AS (SELECT id, CASE WHEN p_type = 'STANDARD' THEN 'inactive' WHEN p_size > 40 THEN 'stale' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'not_relevant' WHEN regexp_matches(p_name, '(?i)\\b(small|tiny)\\b') THEN 'residential' WHEN p_retailprice < 950 THEN 'unverifiable' END AS kind FROM r)"


def classified_register(spark, sf_dir):
    c = F.col
    rules = [
        ("inactive", "status", c("type") == "STANDARD"),
        ("stale", "older than 40 days", F.datediff(c("issued"), F.lit("2001-01-01").cast("date")) > 40),
        ("not_relevant", "class", c("entity").isin("Brand#1", "Brand#2")),
        ("residential", "scope", c("name").rlike(text.word("small|tiny"))),
        ("unverifiable", "valuation", c("valuation") < 950),
    ]
    return chain.verdict(register(spark, sf_dir), rules)


@query(_MAPPED + " SELECT id, kind FROM k")
def register_verdicts(spark, sf_dir):
    return classified_register(spark, sf_dir).select("id", "kind")


@query(_MAPPED + " SELECT coalesce(kind, 'accepted') AS kind, count(*) AS n FROM k GROUP BY 1")
def verdict_counts(spark, sf_dir):
    return chain.tally(classified_register(spark, sf_dir))


@query(_MAPPED + " SELECT count(*) AS fetched, count(*) FILTER (kind IS NULL) AS accepted, count(kind) AS rejected, count(*) = count(*) FILTER (kind IS NULL) + count(kind) AS conserved FROM k")
def conservation(spark, sf_dir):
    n, ok, bad = F.count("*"), F.count_if(F.col("kind").isNull()), F.count("kind")
    return classified_register(spark, sf_dir).agg(n.alias("fetched"), ok.alias("accepted"), bad.alias("rejected"), (n == ok + bad).alias("conserved"))
