"""Queries on intake, selection, patches, quotas and cursors of records, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpi, records, resolve, segments, views
from . import catalog
from .prospects import _PROSPECTS

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


_FORMS = """WITH forms AS (SELECT c_custkey AS id, c_name AS n, c_custkey % 13 = 0 AS trap, (c_custkey * 37) % 9000 AS ms,
  CASE c_custkey % 5 WHEN 0 THEN ' Ana' || c_custkey || '@Shop.COM ' WHEN 1 THEN 'no-at-sign' WHEN 2 THEN 'x@mailinator.com' WHEN 3 THEN NULL ELSE 'b' || c_custkey || '@site.org' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN '(619) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '+52 664 123' ELSE NULL END AS phone,
  CASE c_custkey % 4 WHEN 0 THEN '2024-02-' || lpad((c_custkey % 40)::VARCHAR, 2, '0') ELSE 'soon' END AS day FROM customer)
"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "CASE WHEN c_custkey % 13 = 0 THEN 'http://spam' ELSE ' ' END AS company_website", "cast((c_custkey * 37) % 9000 AS string) AS form_time_ms",
        "CASE c_custkey % 5 WHEN 0 THEN concat(' Ana', c_custkey, '@Shop.COM ') WHEN 1 THEN 'no-at-sign' WHEN 2 THEN 'x@mailinator.com' WHEN 3 THEN NULL ELSE concat('b', c_custkey, '@site.org') END AS email",
        "CASE c_custkey % 3 WHEN 0 THEN concat('(619) 555-', lpad(cast(c_custkey % 10000 AS string), 4, '0')) WHEN 1 THEN '+52 664 123' END AS phone",
        "CASE c_custkey % 4 WHEN 0 THEN concat('2024-02-', lpad(cast(c_custkey % 40 AS string), 2, '0')) ELSE 'soon' END AS preferred_date",
        "repeat('long words ', cast(c_custkey % 300 AS int)) AS message",
    )


@query(_FORMS + """SELECT id, lower(trim(coalesce(email, ''))) AS email, CASE WHEN NOT regexp_matches(lower(trim(coalesce(email, ''))), '^[^\\s@]+@[^\\s@]+\\.[a-z]{2,}$') OR email LIKE '%mailinator.com' THEN 'invalid_email' END AS reject,
  CASE id % 3 WHEN 0 THEN '+1619555' || lpad((id % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '+52664123' ELSE '' END AS phone, try_cast(day AS DATE) AS preferred_date,
  least(1500, greatest(0, (id % 300) * 11 - 1)) AS message_length, ms > 0 AND ms < 3000 AS fast, 'widget' AS source FROM forms WHERE NOT trap""")
def form_intake(spark, sf_dir):
    """SRC-12."""
    out = records.intake(_forms(spark, sf_dir))
    return out.select("id", "email", "reject", "phone", "preferred_date", F.length("message").cast("long").alias("message_length"), "fast", "source")


_LIST = _PROSPECTS + """p AS (SELECT *, (id * 37) % 101 AS icp_score, TIMESTAMP '2024-01-01' + to_days((id % 50)::INT) AS created_at, (['discovered', 'enriched', 'qualified', 'contacted', 'rejected'])[id % 5 + 1] AS stage,
  CASE id % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'k' || id END AS dedupe_key FROM v_prospects)
"""


def _list(spark, sf_dir):
    return views.prospects(spark, sf_dir).selectExpr(
        "*", "(id * 37) % 101 AS icp_score", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 50 AS int)) AS created_at", "element_at(array('discovered', 'enriched', 'qualified', 'contacted', 'rejected'), cast(id % 5 AS int) + 1) AS stage",
        "CASE id % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat('k', id) END AS dedupe_key",
    )


@query(_LIST + ", hits AS (SELECT * FROM p WHERE stage = 'qualified' AND (business_name ILIKE '%site1%' OR coalesce(email, '') ILIKE '%site1%' OR coalesce(website, '') ILIKE '%site1%' OR zip ILIKE '%site1%')) SELECT id, business_name, icp_score, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY icp_score DESC, created_at DESC, id LIMIT 20 OFFSET 1")
def prospect_list_page(spark, sf_dir):
    """FLT-02, SRT-02."""
    return records.prospect_page(_list(spark, sf_dir), stage="qualified", text="Site1", limit=20, offset=1).select("id", "business_name", "icp_score", "total")


@query(_LIST + "SELECT id, icp_score FROM p WHERE stage = 'qualified' ORDER BY icp_score DESC, created_at, id LIMIT 25")
def outreach_queue(spark, sf_dir):
    """SRT-04."""
    return kpi.top(_list(spark, sf_dir).where("stage = 'qualified'"), 25, F.desc("icp_score"), F.col("created_at"), F.col("id")).select("id", "icp_score")


@query(_LIST + "SELECT id, stage FROM p WHERE trim(coalesce(dedupe_key, '')) <> '' AND trim(business_name) <> '' AND stage IN ('enriched', 'qualified', 'contacted') ORDER BY icp_score DESC, created_at DESC, id LIMIT 60")
def sync_selection(spark, sf_dir):
    """FLT-05."""
    return records.selected(_list(spark, sf_dir).withColumnRenamed("created_at", "updated_at"), 60).select("id", "stage")


_COMPANIES = """WITH companies AS (SELECT o_orderkey AS id, lower(substr(o_orderpriority, 3)) || ':' || lpad(o_orderkey::VARCHAR, 9, '0') AS key, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS last_verified,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS deleted_at FROM orders)
"""


def _companies(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat(lower(substring(o_orderpriority, 3)), ':', lpad(cast(o_orderkey AS string), 9, '0')) AS key", "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS last_verified", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS deleted_at"
    )


@query(_COMPANIES + "SELECT id, key FROM companies WHERE starts_with(key, 'urgent:') AND id < 900 ORDER BY id DESC LIMIT 40")
def keys_below_cursor(spark, sf_dir):
    """FLT-06, FLT-07."""
    return records.before_cursor(_companies(spark, sf_dir), "urgent", 900, 40).select("id", "key")


_STATE = _COMPANIES + ", state AS (SELECT split_part(key, ':', 1) AS namespace, min(key) AS lowest_key, arg_max(key, (last_verified, key)) FILTER (deleted_at IS NULL AND last_verified IS NOT NULL) AS latest_key, max(last_verified) FILTER (deleted_at IS NULL) AS last_verified FROM companies GROUP BY 1)"


@query(_STATE + " SELECT * FROM state")
def namespace_state(spark, sf_dir):
    """AGG-17, AGG-18."""
    return records.namespace_state(_companies(spark, sf_dir))


_QUOTA = """WITH q AS (SELECT event_id AS id, event_id % 7 <> 0 AS known, CASE WHEN event_id % 11 <> 0 THEN ts END AS last_verified FROM events)
SELECT id, reason, reason IS NULL AS allowed FROM (SELECT id, CASE WHEN NOT known THEN NULL WHEN last_verified IS NULL THEN 'undetermined' WHEN date_sub('second', last_verified, TIMESTAMP '2024-01-20 12:00:00') < -300 THEN 'undetermined'
  WHEN date_sub('second', last_verified, TIMESTAMP '2024-01-20 12:00:00') < 86400 THEN 'within_24h' END AS reason FROM q)"""


@query(_QUOTA)
def durable_quota(spark, sf_dir):
    """STR-09."""
    q = views.table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id % 7 <> 0 AS known", "CASE WHEN event_id % 11 <> 0 THEN ts END AS last_verified")
    return records.durable_quota(q, "2024-01-20 12:00:00").select("id", "reason", "allowed")


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey ELSE '' END AS loc, c_custkey % 4 <> 1 AS conf, c_custkey % 5 <> 2 AS ok,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'other:9' ELSE 'ns:' || c_custkey END AS k, c_custkey % 2 = 0 AS boot FROM customer)
SELECT id, CASE WHEN loc <> '' THEN 'incremental' WHEN conf AND (NOT ok OR k LIKE 'other%') THEN 'blocked' WHEN conf AND k IS NULL THEN 'bootstrap' WHEN conf THEN 'incremental' WHEN boot THEN 'bootstrap' ELSE 'blocked' END AS mode,
  CASE WHEN loc <> '' THEN loc WHEN conf AND ok AND k LIKE 'ns:%' THEN substr(k, 4) END AS cursor, CASE WHEN loc <> '' THEN 'local' WHEN conf THEN 'crm' ELSE 'none' END AS origin FROM c""")
def resolved_cursors(spark, sf_dir):
    """STR-10."""
    c = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN concat('L', c_custkey) ELSE '' END AS local", "c_custkey % 4 <> 1 AS crm_configured", "c_custkey % 5 <> 2 AS crm_ok",
        "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'other:9' ELSE concat('ns:', c_custkey) END AS crm_key", "'ns' AS namespace", "c_custkey % 2 = 0 AS bootstrap_allowed",
    )
    return records.resolved_cursor(c).select("id", "mode", "cursor", "origin")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS sent FROM events WHERE event_type = 'signup' GROUP BY 1")
def sent_per_day(spark, sf_dir):
    """AGG-16."""
    return views.sends(spark, sf_dir).where("kind = 'sent'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("sent"))


@query(_PROSPECTS + """e AS (SELECT id, CASE WHEN id % 5 > 0 THEN 'office' END AS segment, email, website, phone, in_area, signal_type <> 'active_permit' AS official FROM v_prospects),
r AS (SELECT *, CASE WHEN phone <> '' THEN 25 ELSE 0 END + CASE WHEN in_area THEN 15 ELSE 0 END + CASE WHEN official THEN 10 ELSE 0 END + CASE WHEN id % 900 <> 0 THEN 10 ELSE 0 END AS s FROM e)
SELECT 'segment' AS kind, coalesce(segment, '(none)') AS value, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'rating', (CASE WHEN s >= 70 THEN 4 WHEN s >= 50 THEN 3 WHEN s >= 30 THEN 2 ELSE 1 END)::VARCHAR, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'not_proposed', v, count(*) FROM (SELECT unnest(list_filter([CASE WHEN segment IS NULL THEN 'segment' END, CASE WHEN email = '' THEN 'email' END, CASE WHEN website IS NULL THEN 'website' END, CASE WHEN phone = '' THEN 'phone' END], lambda x: x IS NOT NULL)) AS v FROM r) GROUP BY ALL""")
def enrichment_histograms(spark, sf_dir):
    """AGG-23: the three histograms in one pass."""
    from ..operators import scoring

    p = views.prospects(spark, sf_dir).selectExpr("id", "phone <> '' AS has_channel", "in_area", "signal_type <> 'active_permit' AS official", "id % 900 <> 0 AS has_address", "1 AS old_rating", "'NEW' AS old_stage", "'x' AS service_area", "CASE WHEN id % 5 > 0 THEN 'office' END AS segment", "email", "website", "phone")
    plan = scoring.enrichment_plan(p)
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), c.alias("value")))
    missing = F.transform("not_proposed", lambda x: F.struct(F.lit("not_proposed").alias("kind"), x.alias("value")))
    each = plan.select(F.explode(F.concat(one("segment", F.coalesce("segment", F.lit("(none)"))), one("rating", F.col("rating").cast("string")), missing)).alias("x"))
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, s_name AS prospect FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey")
def step_prospect_left(spark, sf_dir):
    """JN-03: the prospect of a step's lead, which may be absent."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("s_suppkey"))
    return o.join(views.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("prospect")), "s_suppkey", "left").select("id", "prospect")


@query("SELECT c_custkey AS id, e.seen AS evidence_at, e.seen IS NOT NULL AS has_evidence FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS seen FROM orders GROUP BY 1) e ON c_custkey = o_custkey")
def company_evidence(spark, sf_dir):
    """JN-13."""
    e = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("evidence_at"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(e, "id", "left").select("id", "evidence_at", F.col("evidence_at").isNotNull().alias("has_evidence"))


@query("WITH s AS (SELECT c_custkey AS company, 'job ' || (c_custkey % 700) AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000) SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT company FROM s) OR 'job ' || (o_orderkey % 1000) IN (SELECT name FROM s)")
def existing_opportunities(spark, sf_dir):
    """JN-14: by company or by name."""
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS company", "concat('job ', o_orderkey % 1000) AS name")
    s = views.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 8000").selectExpr("c_custkey AS company", "concat('job ', c_custkey % 700) AS name")
    return records.either_key(o, s, ["company", "name"]).select("id")


@query("SELECT o_orderkey AS id, o_orderpriority AS rating FROM orders ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END DESC, o_orderkey LIMIT 30")
def rating_slice(spark, sf_dir):
    """SRT-08: an enumeration ranked by a map, ties by key."""
    rank = F.create_map(*[F.lit(x) for k in range(1, 6) for x in (str(k), 6 - k)])
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("rating"))
    return kpi.top(o, 30, F.desc(rank[F.substring("rating", 1, 1)]), F.col("id"))


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_quantity > 30 ORDER BY l_orderkey, l_linenumber LIMIT 50")
def first_in_file_order(spark, sf_dir):
    """SRT-07: the first rows that pass, by an ordinal of the file."""
    li = views.table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    return resolve.capped(li, 50, F.col("id"), F.col("line"))


@query("SELECT 'permits' AS source, s_suppkey AS id, s_name AS name, NULL AS zip FROM supplier UNION ALL SELECT 'schools', c_custkey, c_name, CAST(90000 + c_custkey % 50 AS VARCHAR) FROM customer UNION ALL SELECT 'licenses', p_partkey, p_name, NULL FROM part")
def all_candidates(spark, sf_dir):
    """SET-02."""
    s = views.table(spark, sf_dir, "supplier").selectExpr("'permits' AS source", "s_suppkey AS id", "s_name AS name")
    c = views.table(spark, sf_dir, "customer").selectExpr("'schools' AS source", "c_custkey AS id", "c_name AS name", "cast(90000 + c_custkey % 50 AS string) AS zip")
    p = views.table(spark, sf_dir, "part").selectExpr("p_name AS name", "'licenses' AS source", "p_partkey AS id")
    return c.unionByName(s, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat_ws(',', 'a' || s_suppkey || '@x.com', CASE WHEN s_suppkey % 3 = 0 THEN 'b@y.org' END) END AS mails FROM supplier")
def further_mails(spark, sf_dir):
    """SET-06."""
    s = views.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 4 > 0 THEN 'p@x.com' END AS primary", "array(concat(' A', s_suppkey, '@X.com'), concat('a', s_suppkey, '@x.COM'), ' ', CASE WHEN s_suppkey % 3 = 0 THEN 'B@y.org' ELSE '' END) AS others")
    return s.select("id", F.array_join(records.further_mails(F.col("primary"), F.col("others")), ",").alias("mails"))


@query("""SELECT o_orderkey AS id, k % 5 IN (0, 1) OR k % 5 = 4 AS link, k % 3 <> 2 AS email, k % 4 <> 3 AS address, k % 7 < 5 AS instant, k % 6 IN (0, 1) AS plain
FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def field_equality(spark, sf_dir):
    """FN-43."""
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey AS k").selectExpr(
        "id",
        "concat('https://x.org/', k, '/') AS link_old", "CASE k % 5 WHEN 0 THEN concat('https://x.org/', k) WHEN 1 THEN concat(' https://x.org/', k, '//') WHEN 2 THEN concat('https://x.org/', k, '/a') WHEN 3 THEN '' ELSE NULL END AS link_new",
        "concat('Ana', k, '@X.org') AS email_old", "CASE k % 3 WHEN 0 THEN concat('ana', k, '@x.ORG') WHEN 1 THEN concat('Ana', k, '@X.org ') ELSE 'b@x.org' END AS email_new",
        "CASE WHEN k % 4 < 2 THEN NULL ELSE '1 A St' END AS address_old", "CASE k % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL WHEN 2 THEN '1 A St ' ELSE '2 A St' END AS address_new",
        "'2024-01-02T03:04:05Z' AS instant_old", "CASE WHEN k % 7 < 3 THEN '2024-01-02T04:04:05+01:00' WHEN k % 7 < 5 THEN '2024-01-02T03:04:05.000Z' WHEN k % 7 = 5 THEN '2024-01-02T03:04:06Z' ELSE 'never' END AS instant_new",
        "CASE WHEN k % 6 = 2 THEN NULL ELSE 'text' END AS plain_old", "CASE k % 6 WHEN 0 THEN ' text' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Text' END AS plain_new",
    )
    return o.select("id", *[records.same_value(kind, F.col(f"{kind}_old"), F.col(f"{kind}_new")).alias(kind) for kind in ("link", "email", "address", "instant", "plain")])


_PATCHES = """WITH l AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'quoted' ELSE 'new' END AS status, 'n' || o_orderkey AS notes, 'own' AS owner FROM orders),
p AS (SELECT id, (['won', 'lost', '', 'nonsense', 'engaged', 'spam'])[id % 6 + 1] AS st, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '' ELSE ' note ' END AS nt, CASE WHEN id % 5 = 0 THEN ' Eva ' ELSE '' END AS ow FROM l WHERE id % 2 = 0),
j AS (SELECT l.*, nullif(st, '') AS st, nt, ow FROM l LEFT JOIN (SELECT * FROM p WHERE st <> 'nonsense') p ON l.id = p.id),
u AS (SELECT id, coalesce(st, status) AS status, coalesce(trim(nt), notes) AS notes, coalesce(nullif(trim(ow), ''), owner) AS owner, CASE WHEN st IS NOT NULL THEN status || '>' || st END AS event, CASE WHEN st IN ('won', 'lost', 'booked', 'spam') THEN 'status:' || st END AS cancel FROM j)
"""


def _patched(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    leads = o.selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'quoted' ELSE 'new' END AS status", "concat('n', o_orderkey) AS notes", "'own' AS owner")
    p = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "element_at(array('won', 'lost', '', 'nonsense', 'engaged', 'spam'), cast(o_orderkey % 6 AS int) + 1) AS new_status", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ' note ' END AS new_notes", "CASE WHEN o_orderkey % 5 = 0 THEN ' Eva ' ELSE '' END AS new_owner")
    return records.patched(leads, p)


@query(_PATCHES + "SELECT * FROM u")
def patched_leads(spark, sf_dir):
    """DML-02."""
    return _patched(spark, sf_dir)


@query(_PATCHES + "SELECT id, step, CASE WHEN state = 'pending' AND cancel IS NOT NULL THEN 'cancelled' ELSE state END AS state, CASE WHEN state = 'pending' THEN cancel END AS reason FROM (SELECT id, cancel, unnest([{'step': 'quote', 'state': 'sent'}, {'step': 'day_1', 'state': 'pending'}, {'step': 'day_3', 'state': 'pending'}], recursive := TRUE) FROM u)")
def cancelled_steps(spark, sf_dir):
    """STR-03."""
    p = _patched(spark, sf_dir)
    steps = p.select("id", F.inline(F.array(*[F.struct(F.lit(a).alias("step"), F.lit(b).alias("state")) for a, b in (("quote", "sent"), ("day_1", "pending"), ("day_3", "pending"))])))
    return records.cancelled(steps, p.where("cancel IS NOT NULL").select("id", F.col("cancel").alias("reason")))


@query("WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT c_custkey AS id, u.user_id IS NOT NULL AS unsubscribed, CASE WHEN u.user_id IS NOT NULL THEN c_custkey % 4 ELSE 0 END AS cancelled, CASE WHEN u.user_id IS NOT NULL THEN 'unsubscribed' END AS event FROM customer LEFT JOIN u ON c_custkey = user_id")
def unsubscribe_effects(spark, sf_dir):
    """STR-05: the flag, the pending steps that are cancelled with it, and the event."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    gone = views.sends(spark, sf_dir).where("kind = 'failed'").select(F.col("lead_id").alias("id")).distinct().withColumn("reason", F.lit("unsubscribed"))
    steps = c.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step")).select("id", "step", F.when(F.col("step") < F.col("id") % 4, "pending").otherwise("sent").alias("state"))
    done = records.cancelled(steps, gone).groupBy("id").agg(F.count_if(F.col("state") == "cancelled").alias("cancelled"))
    j = c.join(done, "id").join(gone, "id", "left")
    return j.select("id", F.col("reason").isNotNull().alias("unsubscribed"), "cancelled", F.col("reason").alias("event"))


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 60 MINUTE")
def unexpired_hits(spark, sf_dir):
    """DML-03."""
    return records.unexpired(views.table(spark, sf_dir, "events"), "2024-01-20 12:00:00", 60).select(F.col("event_id").alias("id"))


def _drafts_sql() -> str:
    from .texts import _inbound_sql

    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.DRAFTS.items())
    why = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.NO_DRAFT.items())
    return f"SELECT conv_id, turn, CASE category {named} END AS template, CASE category {why} END AS why FROM ({_inbound_sql()})"


@query(_drafts_sql())
def draft_suggestions(spark, sf_dir):
    """CLS-19."""
    from .texts import inbound_messages

    template, why = records.draft(F.col("category"))
    found = inbound_messages(spark, sf_dir).select("conv_id", "turn", segments.inbound_category(F.col("text")).alias("category"))
    return found.select("conv_id", "turn", template.alias("template"), why.alias("why"))


@query("SELECT o_orderkey AS id, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-06-15')) AS since, CAST(ceil(date_sub('second', TIMESTAMP '2000-06-15 18:00:00', CAST(o_orderdate AS DATE) + INTERVAL 12 HOUR) / 86400.0) AS INT) AS until FROM orders")
def day_distances(spark, sf_dir):
    """FN-34."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    now = "2000-06-15 18:00:00"
    return o.select("id", records.days_since(F.col("day"), now).cast("long").alias("since"), records.days_until(F.col("day"), now).alias("until"))
