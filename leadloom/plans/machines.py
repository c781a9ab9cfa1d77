"""Queries on state machines, ranks with their remainder, and inserts that leave existing rows alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import drip, lookup, ordered, resolve, views
from ..sources.strict import read_strict
from ..sources.upsert import UpsertTable
from ..streaming import audit
from ..tables import shared_folder
from . import catalog
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


# ---- scheduled mail

#: Closed (22:00 in the send zone), open, open, open, closed.
TICKS = ["2001-08-02 05:00:00", "2001-08-02 16:00:00", "2001-08-02 16:30:00", "2001-08-02 22:00:00", "2001-08-03 04:00:00"]


def _channel_leads(spark, sf_dir):
    """Every lead with its contact channel and the sequence that was asked for, if any."""
    return views.leads(spark, sf_dir).selectExpr(
        "id", "customer", "segment", "status AS lead_status", "created_at", "CASE WHEN customer % 6 = 0 THEN 'outbound' ELSE 'form' END AS contact_channel",
        "CASE WHEN id % 31 = 0 THEN 'commercial' WHEN id % 37 = 0 THEN 'spring_offer' WHEN id % 5 = 0 THEN ' ' END AS sequence", "id % 19 = 0 AS unsubscribed",
    )


def _steps_values() -> str:
    return ", ".join(f"('{s}', '{n}', {k}, {m})" for s, steps in catalog.SEQUENCES.items() for k, (n, m) in enumerate(steps))


_ENROLLED = (
    _LEADS
    + f""", catalog(sequence, step, position, delay) AS (VALUES {_steps_values()}),
named AS (SELECT id, customer, status AS lead_status, created_at, id % 19 = 0 AS unsubscribed,
  CASE WHEN id % 31 = 0 THEN 'commercial' WHEN id % 37 = 0 THEN 'spring_offer' WHEN customer % 6 = 0 THEN 'outbound' WHEN segment = 'commercial' THEN 'commercial' ELSE 'residential' END AS sequence FROM v_leads),
t0 AS (SELECT n.*, step, position, created_at + to_minutes(delay) AS scheduled_at, CASE WHEN step IS NULL THEN 'unknown_sequence' ELSE 'pending' END AS mail_status, NULL::VARCHAR AS error FROM named n LEFT JOIN catalog USING (sequence))"""
)


@query(_ENROLLED + " SELECT id, sequence, step, position, scheduled_at, mail_status AS status, error FROM t0")
def sequence_enrolment(spark, sf_dir):
    """STR-01: which sequence a lead gets, and its steps."""
    leads = _channel_leads(spark, sf_dir)
    return drip.enrolled(None, leads, F.col("created_at"))


@query(
    _ENROLLED
    + ", had AS (SELECT id, sequence, step, position, scheduled_at, CASE WHEN id % 2 = 0 THEN 'sent' ELSE mail_status END AS status, error FROM t0 WHERE position IS NULL OR position < 2 OR id % 3 = 0)"
    + " SELECT id, sequence, step, position, scheduled_at, status, error FROM had UNION ALL SELECT id, sequence, step, position, scheduled_at + INTERVAL 1 DAY, mail_status, error FROM t0 WHERE (position >= 2 AND id % 3 <> 0) OR step IS NULL"
)
def second_enrolment(spark, sf_dir):
    """STR-01 again, a day later, where a part of the steps exists: those stay, sent or not, and only the others are added."""
    leads = _channel_leads(spark, sf_dir)
    had = drip.enrolled(None, leads, F.col("created_at")).where("position IS NULL OR position < 2 OR id % 3 = 0")
    had = had.withColumn("status", F.when(F.col("id") % 2 == 0, "sent").otherwise(F.col("status")))
    return drip.enrolled(had, leads, F.col("created_at") + F.expr("INTERVAL '1' DAY"))


def _refusal_sql(k: int) -> str:
    return f"CASE WHEN {k} = 1 AND customer % 7 = 1 THEN 'daily_limit_reached' WHEN {k} = 2 AND customer % 7 = 2 THEN 'outbound_disabled' WHEN customer % 11 = 2 THEN 'domain_cooldown' END"


def _mail_error_sql(k: int) -> str:
    return f"CASE WHEN (id + position) % 10 = 0 THEN 'mailbox full' WHEN {k} = 1 AND (id + position) % 5 = 1 THEN 'timeout' END"


def _tick_sql(k: int, now: str, is_open: bool) -> str:
    """A tick as SQL: what the due steps do, then what becomes of all steps."""
    stops = ", ".join(f"'{s}'" for s in catalog.STOP_STATUSES)
    return f""",
a{k} AS (SELECT *, CASE WHEN mail_status <> 'pending' OR scheduled_at > TIMESTAMP '{now}' THEN NULL
    WHEN unsubscribed OR lead_status IN ({stops}) THEN 'stop'
    WHEN NOT {is_open} AND step <> 'quote' THEN 'wait'
    WHEN sequence = 'outbound' AND ({_refusal_sql(k)}) IN ('daily_limit_reached', 'outbound_disabled') THEN 'later'
    WHEN sequence = 'outbound' AND ({_refusal_sql(k)}) IS NOT NULL THEN 'refuse'
    WHEN ({_mail_error_sql(k)}) IS NULL THEN 'send' WHEN error LIKE 'retry:%' THEN 'fail' ELSE 'retry' END AS act, {_refusal_sql(k)} AS refusal, {_mail_error_sql(k)} AS answer FROM t{k}),
b{k} AS (SELECT *, max(CASE WHEN act = 'refuse' THEN refusal END) OVER (PARTITION BY id) AS ended FROM a{k}),
c{k} AS (SELECT *, ended IS NOT NULL AND mail_status = 'pending' AND (act IS NULL OR act IN ('wait', 'later', 'retry')) AS dragged FROM b{k}),
t{k + 1} AS (SELECT id, customer, lead_status, created_at, unsubscribed, sequence, step, position,
    CASE act WHEN 'later' THEN TIMESTAMP '{now}' + INTERVAL 6 HOUR WHEN 'retry' THEN TIMESTAMP '{now}' + INTERVAL 30 MINUTE ELSE scheduled_at END AS scheduled_at,
    CASE WHEN act IN ('stop', 'refuse') OR dragged THEN 'cancelled' WHEN act = 'send' THEN 'sent' WHEN act = 'fail' THEN 'failed' ELSE mail_status END AS mail_status,
    CASE WHEN act = 'stop' THEN CASE WHEN unsubscribed THEN 'unsubscribed' ELSE 'lead_status:' || lead_status END WHEN act = 'refuse' THEN refusal WHEN dragged THEN ended
      WHEN act = 'later' THEN 'deferred:' || refusal WHEN act = 'retry' THEN 'retry:' || answer WHEN act = 'fail' THEN answer ELSE error END AS error FROM c{k})"""


_OPEN = [False, True, True, True, False]


@query(_ENROLLED + "".join(_tick_sql(k, now, is_open) for k, (now, is_open) in enumerate(zip(TICKS, _OPEN, strict=True))) + f" SELECT id, sequence, step, scheduled_at, mail_status AS status, error FROM t{len(TICKS)}")
def drip_ticks(spark, sf_dir):
    """STR-02: five ticks over all steps. Leads are shuffled once; the ticks share that partitioning."""
    facts = _channel_leads(spark, sf_dir)
    steps = drip.enrolled(None, facts, F.col("created_at")).join(facts.select("id", "customer", "unsubscribed", "lead_status"), "id")
    for k, now in enumerate(TICKS):
        steps = drip.tick(steps, now, F.expr(_refusal_sql(k)), F.expr(_mail_error_sql(k)))
    return steps.select("id", "sequence", "step", "scheduled_at", "status", "error")


# ---- ranks with their remainder


@query("SELECT id, score, CASE WHEN row_number() OVER (ORDER BY score DESC, id) <= 50 THEN 'kept' ELSE 'over_cap' END AS outcome FROM (" + _LEADS + "SELECT id, score FROM scored)")
def capped_with_remainder(spark, sf_dir):
    """WIN-02, WIN-03, AGG-25: the best fifty of all scored leads, and every other one as over_cap."""
    from ..operators import pricing, scoring

    s = scoring.score_leads(pricing.with_quote(views.leads(spark, sf_dir)), views.LEADS_AS_OF)
    return ordered.with_remainder(s.select("id", "score", (-F.col("score")).alias("_down")), 50, "_down", "id").drop("_down")


@query("SELECT count(*) AS taken_in, 50 AS kept, count(*) - 50 AS over_cap, true AS conserved FROM orders JOIN customer ON o_custkey = c_custkey")
def cap_conservation(spark, sf_dir):
    """AGG-25: what came in is what was kept and what was over the cap."""
    out = capped_with_remainder(spark, sf_dir).agg(F.count("*").alias("taken_in"), F.count_if(F.col("outcome") == "kept").alias("kept"), F.count_if(F.col("outcome") == "over_cap").alias("over_cap"))
    n = views.leads(spark, sf_dir).agg(F.count("*").alias("n"))
    return out.join(n).select("taken_in", "kept", "over_cap", ((F.col("kept") + F.col("over_cap") == F.col("taken_in")) & (F.col("n") == F.col("taken_in"))).alias("conserved"))


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS position FROM events")
def global_positions(spark, sf_dir):
    """Every event's number in one order of all, without a window over all."""
    e = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return ordered.numbered(e, "user_id", "ts", "event_id").select("event_id", "position")


# ---- inserts and plans that leave rows alone


@query(
    "WITH old AS (SELECT o_custkey AS owner, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS owner, o_orderkey AS first FROM orders)"
    " SELECT * FROM old UNION ALL SELECT owner, min(first) FROM new WHERE owner IS NOT NULL AND owner NOT IN (SELECT owner FROM old) GROUP BY 1 UNION ALL SELECT owner, first FROM new WHERE owner IS NULL"
)
def insert_or_ignore(spark, sf_dir):
    """SNK-01, SNK-02, DML-04: rows without a key are all added, a known key none, a new one its first row."""
    o = views.table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("owner")).agg(F.min("o_orderkey").alias("first"))
    new = o.selectExpr("CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS owner", "o_orderkey AS first")
    return resolve.insert_ignore(old, new, ["owner"], "first")


@query(
    "WITH old AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT s_suppkey, 'twin', s_nationkey FROM supplier WHERE s_suppkey % 4 = 0),"
    " new AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) || '!' WHEN s_suppkey % 3 = 1 THEN ' ' ELSE s_name END AS name, s_nationkey + 1 AS nation FROM supplier UNION ALL SELECT -1 - s_suppkey, s_name, 0 FROM supplier)"
    " SELECT o.id, CASE WHEN o.id % 4 = 0 OR trim(n.name) = '' THEN o.name ELSE n.name END AS name, CASE WHEN o.id % 4 = 0 THEN o.nation ELSE n.nation END AS nation FROM old o JOIN new n ON o.id = n.id UNION ALL SELECT id, name, nation FROM new WHERE id < 0"
)
def applied_plan(spark, sf_dir):
    """CHG-02, SNK-05: a plan's actions; ids that stand twice are left as they are."""
    s = views.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation")
    old = s.union(s.where("id % 4 = 0").withColumn("name", F.lit("twin")))
    new = s.selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat(upper(name), '!') WHEN id % 3 = 1 THEN ' ' ELSE name END AS name", "nation + 1 AS nation")
    return resolve.apply_plan(old, new.union(s.selectExpr("-1 - id AS id", "name", "0 AS nation")), "id", ["name", "nation"])


# ---- catalogs as tables


@query("SELECT p_partkey AS part, count(*) AS orders, min(o_orderkey) AS first FROM part JOIN orders ON o_orderkey BETWEEN p_partkey * 7 - 500 AND p_partkey * 7 - 500 + p_size * p_size GROUP BY 1")
def range_lookup(spark, sf_dir):
    """JN-17: ranges as a table of any size, some of them below zero; an equality join with counts of blocks, no nested loop."""
    ranges = views.table(spark, sf_dir, "part").selectExpr("p_partkey AS part", "p_partkey * 7 - 500 AS low", "p_partkey * 7 - 500 + p_size * p_size AS high")
    return lookup.range_counts(views.table(spark, sf_dir, "orders"), ranges, "part", "o_orderkey", "low", "high").withColumnRenamed("n", "orders")


@query("SELECT DISTINCT doc_id, word FROM documents JOIN (SELECT DISTINCT right(c_name, 4) AS word FROM customer UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part) ON contains(text, word)")
def keyword_automaton(spark, sf_dir):
    """JN-16: thousands of keywords against whole texts, one pass over each."""
    c, p = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "part")
    words = c.select(F.right("c_name", F.lit(4)).alias("word")).union(p.select(F.explode(F.split("p_name", " "))))
    return lookup.keyword_hits(views.table(spark, sf_dir, "documents"), words, "doc_id", "text", "word").select("doc_id", "word")


# ---- digests, audit rows, merges

_PLAIN = "'{\"at\":{\"e\":' || event_id || ',\"u\":' || user_id || '},\"k\":' || (props->>'$.k') || ',\"list\":[{\"a\":1,\"b\":\"' || event_type || '\"}]}'"


@query(f"SELECT event_id, 'sha256:' || sha256({_PLAIN}) AS digest, true AS same, event_id % 5 = 0 AS altered FROM events")
def document_digests(spark, sf_dir):
    """FN-41: nested documents whose keys stand in another order, blanks and a hash of their own included, have the same digest."""
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    one = """concat('{"list": [{"b":"', event_type, '", "a":1}], "sha256":"own", "k":', k, ', "at":{"u": ', user_id, ',"e":', event_id, '}}')"""
    two = """concat('{"at":{"e":', event_id, ',"sha256":"x","u":', user_id, '},"k" : ', k, ',"list":[ {"a":', if(event_id % 5 = 0, 2, 1), ',"b":"', event_type, '"}]}')"""
    three = """concat('{"k":', k, ',"list":[{"sha256":"","a":1,"b":"', event_type, '"}],"at":{"e":', event_id, ',"u":', user_id, '}}')"""
    d = [keys.document_hash(F.expr(t)) for t in (one, two, three)]
    return e.select("event_id", d[0].alias("digest"), (d[0] == d[2]).alias("same"), (d[0] != d[1]).alias("altered"))


@query("SELECT 'rows' AS counter, count(*) AS n FROM events UNION ALL SELECT event_type, count(*) FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1 UNION ALL SELECT 'other', count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def audit_counters(spark, sf_dir):
    """AGG-19, SNK-10: the audit row of a run that writes all events, counted in the pass that writes them."""
    path = f"{shared_folder(spark)}/audited-{uuid.uuid4().hex}"
    row = audit.audited_write(views.table(spark, sf_dir, "events"), path, "run", *audit.outcome_counters("event_type", ["view", "click", "purchase"]))
    return row.select(F.explode("metrics").alias("counter", "n"))


@query(
    "WITH first AS (SELECT o_custkey AS id, max(o_orderkey) AS ref, arg_max(o_orderpriority, o_orderkey) AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),"
    " later AS (SELECT o_custkey AS id, arg_max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, o_orderkey) AS ignored, arg_max({'r': CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, 'l': CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderpriority END}, o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)"
    " SELECT id, coalesce(v.r, ref) AS ref, CASE WHEN v.l IS NULL OR trim(v.l) = '' THEN coalesce(label, CASE WHEN first.id IS NULL THEN NULL END) ELSE v.l END AS label FROM first FULL JOIN later USING (id)"
)
def merged_orders(spark, sf_dir):
    """SNK-05, SNK-08, DML-01: a table, a batch merged into it, and the same batch once more, which changes nothing."""
    o = views.table(spark, sf_dir, "orders")
    rows = o.selectExpr("o_custkey AS id", "o_orderkey AS ref", "o_orderpriority AS label", "o_orderkey AS seq", "o_orderstatus")
    table = UpsertTable(spark, f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}", rows.select("id", "ref", "label").schema, "id", 8)
    table.merge(rows.where("o_orderstatus = 'F'"), "seq", "run", 0)
    later = rows.where("o_orderstatus <> 'F'").selectExpr("id", "CASE WHEN ref % 3 <> 0 THEN ref END AS ref", "CASE WHEN ref % 2 = 0 THEN ' ' ELSE label END AS label", "seq")
    table.merge(later, "seq", "run", 1)
    again = table.merge(later, "seq", "run", 1)
    if not again.replayed:
        raise ValueError("a replayed batch was merged again")
    return table.read()


# ---- files

_LINE = '''CASE o_orderkey % 10
  WHEN 1 THEN concat(o_orderkey, ',"', o_orderpriority, '"x,', o_custkey) WHEN 2 THEN concat(o_orderkey, ',a"b"c,', o_custkey) WHEN 3 THEN concat(o_orderkey, ',short')
  WHEN 4 THEN concat(o_orderkey, ',a,', o_custkey, ',long') WHEN 5 THEN concat(o_orderkey, ',"two', chr(10), 'lines, ""said""",', o_custkey) ELSE concat('"', o_orderkey, '",', o_orderpriority, ',', o_custkey) END'''


@query(
    "WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 10 WHEN 1 THEN 'text_after_quote' WHEN 2 THEN 'quote_in_bare_field' WHEN 3 THEN 'short_row' WHEN 4 THEN 'long_row' END AS fault, CASE WHEN o_orderkey % 10 = 5 THEN 'two' || chr(10) || 'lines, \"said\"' ELSE o_orderpriority END AS note FROM orders)"
    " SELECT fault, CASE WHEN fault IS NULL THEN o_orderkey::VARCHAR END AS id, CASE WHEN fault IS NULL THEN note END AS note, CASE WHEN fault IS NULL THEN o_custkey::VARCHAR END AS owner FROM r"
)
def strict_register(spark, sf_dir):
    """SRC-04, SRC-06: orders written as a faulty register and read back; every row is there, sound or with its fault."""
    path = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    o = views.table(spark, sf_dir, "orders")
    head = F.when(F.col("first"), F.concat(F.lit("made by hand\nid,note,owner\n"), F.col("line"))).otherwise(F.col("line"))
    part = F.spark_partition_id()
    numbered = o.select(F.expr(_LINE).alias("line"), part.alias("p"), F.monotonically_increasing_id().alias("m"))
    first = numbered.select("*", (F.col("m") == F.col("p").cast("long") * (1 << 33)).alias("first"))
    first.select(head.alias("value")).write.text(path)
    rows = read_strict(spark, path, ["id", "note", "owner"], banner_lines=1)
    return rows.select(F.col("_fault").alias("fault"), "id", "note", "owner")
