"""Queries on events over time: limits, quotas, schedules, cool-down, attribution, windows; and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import guards, pricing, resolve, scoring, sequential, temporal, views
from ..plans import catalog
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


_ORDERED = "o AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(
    f"WITH RECURSIVE {_ORDERED}, s AS (SELECT event_id, user_id, rn, ts AS start, 1 AS cnt, true AS allowed FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.user_id, o.rn, CASE WHEN o.ts - s.start > INTERVAL 24 HOUR THEN o.ts ELSE s.start END, CASE WHEN o.ts - s.start > INTERVAL 24 HOUR THEN 1 WHEN s.cnt >= 3 THEN s.cnt ELSE s.cnt + 1 END, o.ts - s.start > INTERVAL 24 HOUR OR s.cnt < 3 FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1) SELECT event_id, user_id, allowed FROM s"
)
def rate_limit_anchored(spark, sf_dir):
    return sequential.anchored(views.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86_400)


@query(
    f"WITH RECURSIVE {_ORDERED}, s AS (SELECT event_id, user_id, rn, CASE WHEN event_type = 'purchase' THEN ts END AS last, true AS allowed FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.user_id, o.rn, CASE WHEN (s.last IS NULL OR o.ts - s.last >= INTERVAL 24 HOUR) AND o.event_type = 'purchase' THEN o.ts ELSE s.last END, s.last IS NULL OR o.ts - s.last >= INTERVAL 24 HOUR FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1) SELECT event_id, user_id, allowed FROM s"
)
def quota_24h(spark, sf_dir):
    return sequential.elapsed(views.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400, "event_type = 'purchase'")


@query("SELECT event_id AS id, hour(ts - INTERVAL 8 HOUR) BETWEEN 8 AND 19 AS open FROM events")
def send_hours(spark, sf_dir):
    return views.sends(spark, sf_dir).select("id", guards.in_send_hours(F.col("ts")).alias("open"))


@query("SELECT event_id AS id, user_id % 25 AS domain, count(*) OVER (PARTITION BY user_id % 25 ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS recent FROM events WHERE event_type = 'signup'")
def domain_cooldown(spark, sf_dir):
    return guards.recently_contacted(views.sends(spark, sf_dir).where("kind = 'sent'"), 3).select("id", "domain", "recent")


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) <= least(40, 10 + 5 * greatest(0, date_diff('day', DATE '2024-01-05', CAST(ts AS DATE)))) AS sent FROM events WHERE event_type = 'signup'")
def warmup_budget(spark, sf_dir):
    queue = views.sends(spark, sf_dir).where("kind = 'sent'").withColumn("day", F.to_date("ts"))
    return guards.within_budget(queue, "2024-01-05", F.desc("value"), F.col("id")).select("id", "sent")


@query("SELECT user_id AS lead_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_opened, min(CASE WHEN event_type = 'click' THEN ts END) AS first_clicked FROM events GROUP BY 1")
def first_touch(spark, sf_dir):
    return temporal.first_touch(views.sends(spark, sf_dir), "lead_id", ["opened", "clicked"])


@query("SELECT user_id AS lead_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'won' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'engaged' ELSE 'new' END AS status FROM events GROUP BY 1")
def lead_status(spark, sf_dir):
    """STR-04: a click engages, an open doesn't; a purchase wins."""
    k = F.col("kind")
    return views.sends(spark, sf_dir).groupBy("lead_id").agg(F.when(F.count_if(k == "won") > 0, "won").when(F.count_if(k == "clicked") > 0, "engaged").otherwise("new").alias("status"))


@query("SELECT e.event_id AS id, (SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts) AS source FROM events e WHERE e.event_type = 'view'")
def as_of_attribution(spark, sf_dir):
    """Engine extension: the latest send at or before each open."""
    e = views.sends(spark, sf_dir)
    return temporal.as_of(e, "lead_id", F.col("kind") == "sent", F.col("kind") == "opened", "id").select("id", "source")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5)::BIGINT AS cents FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """Engine extension."""
    t = temporal.tumbling(views.table(spark, sf_dir, "events"), "6 hours", "event_type")
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.floor(F.col("total") * 100 + 0.5).alias("cents"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY start")
def sliding_windows(spark, sf_dir):
    """Engine extension."""
    return temporal.sliding(views.table(spark, sf_dir, "events"), "12 hours", "6 hours").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    """Engine extension."""
    s = temporal.sessions(views.table(spark, sf_dir, "events"), "2 hours", "user_id")
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def interval_join(spark, sf_dir):
    """Engine extension."""
    e = views.sends(spark, sf_dir)
    return temporal.interval_join(e.where("kind = 'opened'"), e.where("kind = 'clicked'"), "lead_id", 21_600)


def _steps_sql() -> str:
    rows = ", ".join(f"('{s}', '{n}', {k}, {m})" for s, steps in catalog.SEQUENCES.items() for k, (n, m) in enumerate(steps))
    return f", steps(sequence, step, position, delay) AS (VALUES {rows}), planned AS (SELECT id, segment, status, created_at, step, position, created_at + to_minutes(delay) AS scheduled_at FROM v_leads JOIN steps ON segment = sequence)"


@query(_LEADS + _steps_sql() + " SELECT id, step, scheduled_at FROM planned")
def step_expansion(spark, sf_dir):
    return guards.enrol(views.leads(spark, sf_dir)).select("id", "step", "scheduled_at")


@query(_LEADS + _steps_sql() + " SELECT id, step, CASE WHEN id % 19 = 0 OR status IN ('won', 'lost', 'booked', 'customer', 'spam') THEN 'cancel' WHEN step <> 'quote' THEN 'defer' ELSE 'send' END AS action FROM planned WHERE scheduled_at <= TIMESTAMP '2001-08-02 05:00:00'")
def drip_state(spark, sf_dir):
    """STR-02 in batch: at 05:00 UTC it is 22:00 in the send zone, so all but first quotes wait."""
    steps = guards.enrol(views.leads(spark, sf_dir))
    return guards.due(steps, "2001-08-02 05:00:00", F.col("id") % 19 == 0).select("id", "step", "action")


@query(_LEADS + _steps_sql() + " SELECT p.id, p.step, q.quote_price FROM planned p JOIN quoted q ON p.id = q.id WHERE scheduled_at <= TIMESTAMP '2001-08-02' ORDER BY scheduled_at, p.id, p.position LIMIT 50")
def due_steps(spark, sf_dir):
    """JN-02 with its batch limit."""
    leads = views.leads(spark, sf_dir)
    steps = guards.enrol(leads).where("scheduled_at <= timestamp_ntz '2001-08-02'")
    j = steps.join(pricing.with_quote(leads).select("id", "quote_price"), "id")
    return j.orderBy("scheduled_at", "id", "position").limit(50).select("id", "step", "quote_price")


@query("WITH s AS (SELECT event_id AS id, user_id % 25 AS domain, user_id, ts, value, count(*) OVER (PARTITION BY user_id % 25 ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS recent, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) <= 40 AS sent FROM events WHERE event_type = 'signup') SELECT id, CASE WHEN id % 41 = 0 THEN 'outbound_disabled' WHEN user_id % 10 = 3 THEN 'suppressed' WHEN user_id % 10 = 4 THEN 'unsubscribed' WHEN recent > 0 THEN 'domain_recently_contacted' WHEN NOT sent THEN 'daily_limit_reached' WHEN user_id % 10 = 5 THEN 'no_mx' END AS reason FROM s")
def guard_cascade(spark, sf_dir):
    s = guards.recently_contacted(views.sends(spark, sf_dir).where("kind = 'sent'"), 1).withColumn("day", F.to_date("ts"))
    s = guards.within_budget(s, None, F.desc("value"), F.col("id"))
    s = s.selectExpr("id", "id % 41 <> 0 AS enabled", "CASE WHEN lead_id % 10 = 3 THEN 'email' END AS suppressed_by", "lead_id % 10 = 4 AS unsubscribed", "recent", "sent", "lead_id % 10 <> 5 AS has_mx")
    return s.select("id", guards.guard_cascade(s).alias("reason"))


@query(_LEADS + "SELECT q.id, q.quote_price, s_name AS prospect FROM quoted q JOIN supplier ON q.customer = s_suppkey WHERE status <> 'won' ORDER BY created_at, q.id LIMIT 100")
def unsynced_inner(spark, sf_dir):
    """JN-01 with its batch limit."""
    q = pricing.with_quote(views.leads(spark, sf_dir)).where("status <> 'won'")
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("customer"), F.col("s_name").alias("prospect"))
    return q.join(s, "customer").orderBy("created_at", "id").limit(100).select("id", "quote_price", "prospect")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error')")
def unsub_anti(spark, sf_dir):
    gone = views.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id")).distinct()
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(gone, "id", "left_anti")


@query("SELECT c_custkey AS id, coalesce(t.type, c_mktsegment) AS type FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS type FROM orders GROUP BY 1) t ON o_custkey = c_custkey")
def type_left_coalesce(spark, sf_dir):
    """JN-12: the latest official type, else the company's own."""
    o = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("official"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return c.join(o, "id", "left").select("id", F.coalesce("official", "c_mktsegment").alias("type"))


@query("SELECT p_partkey AS id, count(*) AS hits FROM part, (VALUES ('tin'), ('red'), ('er'), ('blue'), ('large')) k(word) WHERE contains(lower(p_name), word) GROUP BY 1")
def keyword_theta(spark, sf_dir):
    """JN-16 without a join: the keywords are an array literal."""
    words = F.array(*map(F.lit, ["tin", "red", "er", "blue", "large"]))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower("p_name"), w))).cast("long")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hits.alias("hits")).where("hits > 0")


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    """Engine extension."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    n = F.count("*").alias("n")
    parts = [c.intersect(o).agg(n).select(F.lit("both").alias("side"), "n"), c.subtract(o).agg(n).select(F.lit("customers only").alias("side"), "n"), c.union(o).distinct().agg(n).select(F.lit("either").alias("side"), "n")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5)::BIGINT AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def revenue_by_flag(spark, sf_dir):
    """Engine extension: the large fact table in one pass."""
    l = views.table(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).alias("revenue"), F.count("*").alias("n"))


@query("SELECT count(*) AS broken FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def broken_references(spark, sf_dir):
    l, o = views.table(spark, sf_dir, "lineitem").select("l_orderkey"), views.table(spark, sf_dir, "orders").select("o_orderkey")
    return resolve.broken_references(l, o, "l_orderkey", "o_orderkey").agg(F.count("*").alias("broken"))


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 2000 AS over_budget, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def running_totals(spark, sf_dir):
    """Engine extension. A sum of doubles near the budget is off by its order's rounding: there the sum of their decimals decides."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spent, exact = F.sum("value").over(w), F.sum(F.col("value").try_cast("decimal(28,10)")).over(w)
    over = F.when(F.abs(spent - 2000) < 1e-6, exact > 2000).otherwise(spent > 2000)
    return views.table(spark, sf_dir, "events").select("user_id", "event_id", over.alias("over_budget"), F.lag("event_type").over(w).alias("before"))


@query(_LEADS + "SELECT customer, id, score FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY score DESC, id) AS rn FROM scored) WHERE rn <= 2")
def top_leads_per_customer(spark, sf_dir):
    w = Window.partitionBy("customer").orderBy(F.desc("score"), "id")
    s = scoring.score_leads(pricing.with_quote(views.leads(spark, sf_dir)), views.LEADS_AS_OF)
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("customer", "id", "score")
