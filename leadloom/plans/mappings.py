"""Queries on mappings of records, field by field, and on small rules of files and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, crypto, text
from ..operators import guards, payloads, segments, shapes, views, web
from ..sources import sealed
from . import catalog

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


@query(
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'OPTED_OUT_DO_NOT_CONTACT' WHEN c_custkey % 3 = 0 THEN 'PUBLIC_BUSINESS_EMAIL' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'PUBLIC_BUSINESS_PHONE' WHEN c_custkey % 5 = 0 THEN 'CONTACT_FORM_ONLY' ELSE 'NO_VERIFIED_CHANNEL' END AS contact,"
    " CASE WHEN c_custkey % 9 = 0 THEN 'DO_NOT_CONTACT' WHEN c_mktsegment = 'BUILDING' THEN 'CONTACTED' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 0 THEN 'READY_FOR_OUTREACH' WHEN c_mktsegment = 'MACHINERY' THEN 'QUALIFIED' ELSE 'NEW' END AS stage,"
    " CASE c_nationkey % 5 WHEN 0 THEN 'INBOUND_WEBSITE' WHEN 1 THEN 'BUSINESS_DIRECTORY' WHEN 2 THEN 'REFERRAL' ELSE 'PUBLIC_WEBSITE' END AS origin FROM customer"
)
def delivered_labels(spark, sf_dir):
    """CLS-27: contactability, stage and source of every customer."""
    c = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 9 = 0 THEN true WHEN c_custkey % 2 = 0 THEN false END AS out", "CASE WHEN c_custkey % 3 = 0 THEN 'x@y.com' WHEN c_custkey % 3 = 1 THEN '' END AS email",
        "CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN '619' END AS phone", "c_custkey % 5 = 0 AS form", "CASE c_mktsegment WHEN 'BUILDING' THEN 'contacted' WHEN 'MACHINERY' THEN 'qualified' WHEN 'FURNITURE' THEN 'enriched' END AS stage",
        "c_acctbal > 0 AS channel", "CASE c_nationkey % 5 WHEN 0 THEN 'inbound' WHEN 1 THEN 'public_record' WHEN 2 THEN 'referral' WHEN 3 THEN 'outbound' END AS origin",
    )
    f = F.col
    return c.select("id", payloads.contactability(f("out"), f("email"), f("phone"), f("form")).alias("contact"), payloads.lead_stage(f("stage"), f("out"), f("channel")).alias("stage"), payloads.lead_source(f("origin")).alias("origin"))


_TYPES = ["Retail Food Service", "Dental Clinic", "Charter School", "Book Store", "Property Management", "General Contractor", "Barber", "Wine Bar", "", "Health Care Market"]
_TYPED = "p_size % 10 AS k, CASE WHEN p_size % 4 = 0 THEN '5313' WHEN p_size % 4 = 1 THEN '99' WHEN p_size % 4 = 2 THEN 'n/a' END AS code, p_name AS description"


@query(
    f"WITH t AS (SELECT p_partkey AS id, {_TYPED}, lower(CASE WHEN ({_TYPES!r})[p_size % 10 + 1] = '' THEN 'a shop for ' || p_name ELSE ({_TYPES!r})[p_size % 10 + 1] END) AS words FROM part)"
    " SELECT id, CASE WHEN code = '5313' THEN 'property_managers' WHEN regexp_matches(words, 'restaurant|food facility|food service|coffee|deli|bakery|caterer|market|taquer|pizza|grill|bar\\b') THEN 'restaurants' WHEN regexp_matches(words, 'health care|medical|dental|clinic|school|conference|church') THEN 'offices' WHEN regexp_matches(words, 'retail|store|shop') THEN 'retail' WHEN regexp_matches(words, 'property|real estate|management') THEN 'property_managers' WHEN regexp_matches(words, 'construction|contractor') THEN 'post_construction' END AS segment FROM t"
)
def official_segments(spark, sf_dir):
    """CLS-16: the industry code first, then the words of the official type."""
    p = views.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", *_TYPED.split(", ", 1)[:1], "CASE WHEN p_size % 4 = 0 THEN '5313' WHEN p_size % 4 = 1 THEN '99' WHEN p_size % 4 = 2 THEN 'n/a' END AS code", "concat('a shop for ', p_name) AS description")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), F.col("k").cast("int") + 1)
    return p.select("id", segments.official_segment(F.col("code"), kind, F.col("description")).alias("segment"))


@query("SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' WHEN p_size % 3 = 1 THEN p_name END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_type || ' ' END), ''), p_size::VARCHAR) AS value FROM part")
def first_given_value(spark, sf_dir):
    """PRJ-04: the first of several candidate columns that says something."""
    p = views.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_size % 3 = 0 THEN '  ' WHEN p_size % 3 = 1 THEN p_name END AS a", "CASE WHEN p_size % 2 = 0 THEN concat(p_type, ' ') END AS b", "p_size AS c")
    return p.select("id", text.first_non_blank(F.col("a"), F.col("b"), F.col("c")).alias("value"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages")
def escaped_pages(spark, sf_dir):
    """FN-22 on whole pages."""
    return views.table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped_md5"))


_SECRET = "a shared secret"


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in _SECRET.encode().ljust(64, b"\0"))


@query(f"SELECT doc_id, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(text)))) AS signature FROM documents")
def signed_documents(spark, sf_dir):
    """SNK-07: the signature that goes with a payload."""
    return views.table(spark, sf_dir, "documents").select("doc_id", crypto.hmac_hex(F.col("text"), _SECRET).alias("signature"))


@query("WITH z AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 7 <> 1 THEN ' ' || (92100 + c_custkey % 40) || ' ' END AS zip FROM customer) SELECT id, coalesce(trim(zip), '') IN ('', '92101', '92103', '92130') AS inside FROM z")
def service_area(spark, sf_dir):
    """CLS-21."""
    c = views.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 7 <> 1 THEN concat(' ', 92100 + c_custkey % 40, ' ') END AS zip")
    return c.select("id", contact.in_service_area(F.col("zip"), ["92101", "92103", "92130"]).alias("inside"))


def _rating_sql() -> str:
    return " ".join(f"WHEN code IN ({', '.join(repr(t) for t in types)}) THEN {rating}" for rating, types in catalog.LICENSE_RATING.items())


@query(f"WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_custkey % 100 < 10 THEN '0' ELSE '' END || (o_custkey % 100) END AS code FROM orders) SELECT id, CASE {_rating_sql()} END AS rating FROM c")
def license_ratings(spark, sf_dir):
    """CLS-23."""
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_custkey % 100 AS string) END AS code")
    return o.select("id", segments.license_rating(F.col("code")).alias("rating"))


@query("SELECT 'scout' || (o_custkey % 50) AS prefix, max('scout' || (o_custkey % 50) || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey) AS latest FROM orders GROUP BY 1")
def latest_staging(spark, sf_dir):
    """SRC-15, WIN-08: the last file of each producer by name."""
    names = views.table(spark, sf_dir, "orders").selectExpr("concat('scout', o_custkey % 50, '-', date_format(o_orderdate, 'yyyyMMdd'), '-', o_orderkey) AS name")
    return sealed.latest_per_prefix(names)


@query("SELECT doc_id, regexp_matches(lower(k), 'owner|contact|phone|email|latitude|longitude|administrator|manager_name|person') AS personal FROM (SELECT doc_id, coalesce((['Owner_Name', 'amount', 'contactEmail', 'LATITUDE', 'impersonal', 'price'])[doc_id % 6 + 1], '') || '_' || lang AS k FROM documents)")
def personal_fields(spark, sf_dir):
    """CLS-29 by names of fields."""
    d = views.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(element_at(array('Owner_Name', 'amount', 'contactEmail', 'LATITUDE', 'impersonal', 'price'), cast(doc_id % 6 AS int) + 1), '_', lang) AS k", "lang")
    return d.select("doc_id", F.when(F.col("lang").isNotNull(), web.personal_key(F.col("k"))).alias("personal"))


@query("SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS conflict FROM events")
def conflict_answers(spark, sf_dir):
    """FN-44: by status, by code, by words; a plain refusal is none."""
    e = views.table(spark, sf_dir, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 6 = 0 THEN 409 WHEN event_id % 6 = 4 THEN 400 END AS status", "CASE WHEN event_id % 6 = 1 THEN '23505' WHEN event_id % 6 = 4 THEN 'E_BAD' END AS code", "CASE event_id % 6 WHEN 2 THEN 'Value must be UNIQUE' WHEN 3 THEN 'Conflict while saving' WHEN 4 THEN 'not valid' END AS message")
    return e.select("id", payloads.duplicate_conflict(F.col("status"), F.col("code"), F.col("message")).alias("conflict"))


# ---- bodies of deliveries

_CANONICAL_LEADS = """
WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'outbound' ELSE 'inbound' END AS channel, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END AS company,
  CASE o_orderkey % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Ana  de la Cruz' WHEN 2 THEN ' ' WHEN 3 THEN 'Bo Li' END AS name, 'u' || o_custkey || '@x.com' AS email,
  CASE WHEN o_orderkey % 2 = 0 THEN '619555' || (o_custkey % 10000) END AS phone, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 > 3 THEN 'https://x' || o_custkey || '.com' END AS website,
  'City' || c_nationkey AS city, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(92000 + o_custkey % 99 AS VARCHAR) END AS zip, CASE WHEN o_orderkey % 8 <> 0 THEN (o_custkey % 500) || ' Main St' END AS address,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey * 7 END AS BIGINT) AS annual, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey + 90 END AS BIGINT) AS quote, c_mktsegment AS segment,
  CASE WHEN o_orderkey % 10 < 3 THEN 'hot' WHEN o_orderkey % 10 < 5 THEN '' END AS temperature, 'src' || (o_custkey % 5) AS source, 'Order ' || o_orderkey AS description FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _canonical_leads(spark, sf_dir):
    for t in ("orders", "customer"):
        views.table(spark, sf_dir, t).createOrReplaceTempView(f"_mappings_{t}")
    sql = _CANONICAL_LEADS.replace("VARCHAR", "STRING").replace("FROM orders", "FROM _mappings_orders").replace("JOIN customer", "JOIN _mappings_customer")
    return spark.sql(sql + " SELECT * FROM l")


def _json(*fields: str, number: tuple = (), blank: bool = False) -> str:
    """SQL of a JSON object from `name=expression` fields; blank ones are left out, or kept as empty text."""
    parts = []
    for f in fields:
        k, _, e = f.partition("=")
        text = f"""'"{k}":' || {e}""" if k in number else f"""'"{k}":"' || {e} || '"'"""
        parts.append(f"""'"{k}":"' || coalesce({e}, '') || '"'""" if blank and k not in number else f"CASE WHEN trim(CAST({e} AS VARCHAR)) <> '' THEN {text} END")
    return f"'{{' || concat_ws(',', {', '.join(parts)}) || '}}'"


_SHAPED = f"""{_CANONICAL_LEADS}, p AS (SELECT *, split_part(trim(coalesce(name, '')), ' ', 1) AS given, trim(regexp_replace(trim(coalesce(name, '')), '^\\S*\\s*', '')) AS family,
  CASE WHEN channel = 'outbound' THEN 'Cold Call' ELSE 'Web Site' END AS origin, coalesce(nullif(trim(family), ''), nullif(company, ''), 'Lead') AS last, coalesce(CASE WHEN trim(name) <> '' THEN name END, nullif(company, '')) AS named,
  CASE WHEN annual > 0 THEN annual WHEN quote > 0 THEN quote END AS amount FROM l)
SELECT id, 'rest_lead' AS shape, {_json("firstName=given", "lastName=last", "accountName=company", "emailAddress=email", "phoneNumber=phone", "website=website", "addressCity=city", "addressPostalCode=zip", "addressStreet=address", "source=origin", "status='New'", "opportunityAmount=amount", "opportunityAmountCurrency='USD'", "description=description", number=("opportunityAmount",))} AS body FROM p
UNION ALL SELECT id, 'json_api_lead', '{{"data":{{"type":"Leads","attributes":' || {_json("first_name=given", "last_name=last", "account_name=company", "email1=email", "phone_work=phone", "website=website", "primary_address_city=city", "primary_address_postalcode=zip", "primary_address_street=address", "lead_source=origin", "status='New'", "description=description", blank=True)} || '}}}}' FROM p
UNION ALL SELECT id, 'flat_lead', {_json("name=coalesce(named, 'Lead')", "company=company", "email=email", "phonenumber=phone", "website=website", "city=city", "zip=zip", "address=address", "source=CASE WHEN channel = 'outbound' THEN 2 ELSE 1 END", "status=1", "description=description", number=("source", "status"), blank=True)} FROM p
UNION ALL SELECT id, 'element_lead', {_json("lastname=last", "firstname=given", "company=coalesce(nullif(company, ''), named, 'Lead')", "email=email", "phone=phone", "website=website", "city=city", "code=zip", "leadsource=origin", "description=description", blank=True)} FROM p
UNION ALL SELECT id, 'property_contact', '{{"properties":' || {_json("email=email", "firstname=given", "lastname=family", "phone=phone", "company=company", "website=website", "zip=zip", "city=city", "hs_lead_status='NEW'", "lifecyclestage='lead'")} || '}}' FROM p
UNION ALL SELECT id, 'tagged_contact', rtrim({_json("email=email", "phone=phone", "name=named", "companyName=company", "website=website", "postalCode=zip", "city=city", "source=source")}, '}}') || ',"tags":["' || concat_ws('","', channel, segment, nullif(temperature, '')) || '"]}}' FROM p
UNION ALL SELECT id, 'company_upsert', {_json("dedupKey=CAST(id AS VARCHAR)", "businessName=coalesce(nullif(company, ''), name)", "website=website", "source=source", "email=email", "phone=phone", "contactName=name", "address=address", "city=city", "zip=zip", "channel=channel", "estAnnualValue=annual", "estVisitValue=quote", number=("estAnnualValue", "estVisitValue"))} FROM p"""


@query(_SHAPED)
def delivery_bodies(spark, sf_dir):
    """SNK-06: every lead as the bodies of seven kinds of systems (the eighth, a webhook, is the canonical lead itself)."""
    return shapes.delivered(_canonical_leads(spark, sf_dir)).where("shape <> 'webhook'").select("id", "shape", "body")


# ---- records with all their parts


@query(
    "WITH mails AS (SELECT l_orderkey AS id, string_agg(l_linenumber || '@' || strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS emails FROM lineitem GROUP BY 1),"
    " acts AS (SELECT user_id, string_agg(event_type || '#' || event_id, ',' ORDER BY ts DESC, event_id DESC) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50 GROUP BY 1),"
    f" catalog(sequence, step, position, delay) AS (VALUES {', '.join(repr((s, n, k, m)) for s, steps in catalog.SEQUENCES.items() for k, (n, m) in enumerate(steps))}),"
    " planned AS (SELECT o_orderkey AS id, string_agg(step, ',' ORDER BY delay, position) AS steps FROM orders JOIN customer ON o_custkey = c_custkey JOIN catalog ON sequence = CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'commercial' ELSE 'residential' END GROUP BY 1)"
    " SELECT o_orderkey AS id, coalesce(emails, '') AS emails, coalesce(steps, '') AS steps, coalesce(events, '') AS events FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN mails ON mails.id = o_orderkey LEFT JOIN planned ON planned.id = o_orderkey LEFT JOIN acts ON user_id = o_custkey"
)
def lead_with_children(spark, sf_dir):
    """JN-04: every lead with its mails, newest first, its steps by time, and its latest 50 events. Each child table is one row per
    lead before it meets the others, so that they don't multiply."""
    from pyspark.sql import Window

    c = F.col
    joined = lambda items, text: F.array_join(F.transform(items, text), ",")
    lines = views.table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("id"))
    mails = lines.agg(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey")), asc=False).alias("m"))
    mails = mails.select("id", joined("m", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("@"), F.date_format(x["l_shipdate"], "yyyy-MM-dd"))).alias("emails"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    acts = views.table(spark, sf_dir, "events").withColumn("n", F.row_number().over(newest)).where("n <= 50")
    acts = acts.groupBy(c("user_id").alias("customer")).agg(F.sort_array(F.collect_list(F.struct("n", "event_type", "event_id"))).alias("e"))
    acts = acts.select("customer", joined("e", lambda x: F.concat(x["event_type"], F.lit("#"), x["event_id"].cast("string"))).alias("events"))
    leads = views.leads(spark, sf_dir).select("id", "customer", "segment", "status", "created_at")
    steps = guards.enrol(leads).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("scheduled_at", "position", "step"))).alias("s"))
    steps = steps.select("id", joined("s", lambda x: x["step"]).alias("steps"))
    out = leads.join(mails, "id", "left").join(steps, "id", "left").join(acts, "customer", "left")
    return out.select("id", *[F.coalesce(k, F.lit("")).alias(k) for k in ("emails", "steps", "events")])


_PARTS = """
  CASE WHEN o_orderkey % 3 = 0 THEN 'r' || (o_orderkey % 4) END AS source, CASE o_orderkey % 12 WHEN 0 THEN 'permit_finaled' WHEN 3 THEN 'new_business' WHEN 6 THEN 'permit_finaled' ELSE 'active_permit' END AS kind,
  CASE WHEN o_orderkey % 12 = 6 THEN NULL ELSE '2024-01-0' || (o_orderkey % 9 + 1) END AS day, CASE WHEN o_orderkey % 24 = 0 THEN o_orderkey * 10 END AS valuation, CASE WHEN o_orderkey % 36 = 0 THEN 'new roof' END AS work,
  'site ' || (o_orderkey % 5) AS mail, CASE WHEN o_orderkey % 5 = 1 THEN 'call me' WHEN o_orderkey % 5 = 2 THEN '' END AS message, CASE WHEN o_orderkey % 7 = 1 THEN '/start' END AS page"""


@query(
    f"WITH p AS (SELECT o_orderkey AS id, {_PARTS} FROM orders) SELECT id, concat_ws(chr(10), 'Order ' || id, CASE WHEN source IS NOT NULL THEN concat_ws(chr(10), '', 'Origin: automatic prospecting · ' || source, CASE kind WHEN 'permit_finaled' THEN 'Signal: work finished on ' || coalesce(day, 'an unknown day') || coalesce(' ($' || valuation || ')', '') WHEN 'new_business' THEN 'Signal: opened on ' || day END, CASE WHEN kind = 'permit_finaled' THEN 'Work: ' || work END, 'Mail found: ' || mail) END, CASE WHEN message <> '' THEN concat_ws(chr(10), '', 'Message: ' || message) END, 'Page: ' || page) AS description FROM p"
)
def further_description(spark, sf_dir):
    """PRJ-09: the parts of a description that only some leads have."""
    o = views.table(spark, sf_dir, "orders")
    p = o.selectExpr("o_orderkey AS id", *[x.strip() for x in _split(_PARTS)])
    c = F.col
    prospecting = F.when(c("source").isNotNull(), F.struct("source", F.struct(c("kind").alias("type"), c("day").alias("at"), "valuation", "work").alias("signal"), c("mail").alias("email_source")))
    return p.select("id", payloads.describe_further(F.concat(F.lit("Order "), c("id").cast("string")), prospecting, c("message"), c("page")).alias("description"))


def _split(fields: str) -> list[str]:
    """The expressions of a list in SQL; none of them holds a comma followed by a name of its own."""
    import re

    return [f.replace("\n", " ") for f in re.split(r"(?<=AS source),|(?<=AS kind),|(?<=AS day),|(?<=AS valuation),|(?<=AS work),|(?<=AS mail),|(?<=AS message),", fields)]
