"""Queries on pages, messages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, keys, text
from ..operators import segments, views, web
from ..plans import catalog
from .chain import computed_once

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


def _pages(spark, sf_dir):
    """Pages with a block of contact details, as the tables' pages have few."""
    p = views.table(spark, sf_dir, "pages")
    block = "concat(html, '<p>mailto:Sales@', split_part(url, '/', 3), '\" info@site', page_id % 20, '.com logo@x.png help@', split_part(url, '/', 3), ' (619) 555-', lpad(cast(page_id % 10000 AS string), 4, '0'), '</p>')"
    return p.selectExpr("page_id", "url", "split_part(url, '/', 3) AS host", f"{block} AS html")


_PAGES = "WITH p AS (SELECT page_id, url, split_part(url, '/', 3) AS host, html || '<p>mailto:Sales@' || split_part(url, '/', 3) || '\" info@site' || (page_id % 20) || '.com logo@x.png help@' || split_part(url, '/', 3) || ' (619) 555-' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || '</p>' AS html FROM pages)"


@query("SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', '', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|tr|h1|h2|li)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pages")
def html_to_text(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_to_text(F.col("html"))).alias("text_md5"))


_FOUND = _PAGES + ", f AS (SELECT page_id, host, list_concat(regexp_extract_all(html, '(?i)mailto:([^\"''?>\\s]+)', 1), regexp_extract_all(html, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS raw FROM p), u AS (SELECT page_id, host, i, regexp_replace(lower(raw[i]), '[.,;:]+$', '') AS e FROM f, unnest(range(1, len(raw) + 1)) AS t(i)), d AS (SELECT page_id, host, e, min(i) AS i FROM u GROUP BY ALL), ok AS (SELECT * FROM d WHERE length(e) < 80 AND NOT regexp_matches(e, '(?i)^(?:example|test|your|email|name|user|sentry|wixpress|sample|no-?reply|donotreply)@|@(?:example|sentry|wix|squarespace|godaddy|shopify|wordpress|gmail\\.example)\\.') AND NOT regexp_matches(e, '(?i)\\.(?:png|jpe?g|gif|webp|svg|css|js)$'))"


@query(_FOUND + " SELECT page_id, string_agg(e, ',' ORDER BY i) AS emails FROM ok GROUP BY page_id")
def emails_extracted(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(contact.emails(F.col("html")), ",").alias("emails")).where("emails <> ''")


@query(_FOUND + ", s AS (SELECT *, CASE WHEN regexp_replace(split_part(e, '@', 2), '^www\\.', '') = regexp_replace(host, '^www\\.', '') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(e, '^(?:info|hello|contact|admin|office|hola|contacto|ventas|sales)@') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(e, '^(?:support|help|jobs|careers|privacy|legal|press|media)@') THEN 3 ELSE 0 END AS score FROM ok) SELECT page_id, arg_min(e, (-score, i)) AS best FROM s GROUP BY page_id")
def emails_ranked(spark, sf_dir):
    best = _pages(spark, sf_dir).select("page_id", F.get(contact.ranked_emails(F.col("html"), F.col("host")), F.lit(0)).alias("best"))
    return computed_once(best, "best").where("best IS NOT NULL")


@query(_PAGES + ", t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM p) SELECT page_id, CASE WHEN regexp_matches(t, '(?:\\+?1[-.\\s]?)?\\(?([2-9]\\d{2})\\)?[-.\\s]?(\\d{3})[-.\\s]?(\\d{4})') THEN '+1' || regexp_extract(t, '(?:\\+?1[-.\\s]?)?\\(?([2-9]\\d{2})\\)?[-.\\s]?(\\d{3})[-.\\s]?(\\d{4})', 1) || regexp_extract(t, '(?:\\+?1[-.\\s]?)?\\(?([2-9]\\d{2})\\)?[-.\\s]?(\\d{3})[-.\\s]?(\\d{4})', 2) || regexp_extract(t, '(?:\\+?1[-.\\s]?)?\\(?([2-9]\\d{2})\\)?[-.\\s]?(\\d{3})[-.\\s]?(\\d{4})', 3) ELSE '' END AS phone FROM t")
def phones_extracted(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", contact.page_phone(F.col("html")).alias("phone"))


@query(_PAGES + ", t AS (SELECT page_id, lower(strip_accents(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM p) SELECT page_id, concat_ws(',', CASE WHEN (CASE WHEN contains(t, 'privacy') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'terms') THEN 1 ELSE 0 END) >= 0.6 * 2 THEN 'name' END, CASE WHEN contains(regexp_replace(t, '[^0-9]', '', 'g'), '619555' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0')) THEN 'phone' END, CASE WHEN contains(t, CAST(10000 + page_id AS VARCHAR)) THEN 'zip' END, CASE WHEN contains(t, CAST(page_id + 100 AS VARCHAR)) THEN 'address' END) AS evidence FROM t")
def page_match(spark, sf_dir):
    found = contact.page_evidence(F.col("html"), F.lit("Privacy Terms"), F.expr("concat('(619) 555 ', lpad(cast(page_id % 10000 AS string), 4, '0'))"), F.expr("cast(10000 + page_id AS string)"), F.expr("concat(page_id + 100, ' Main')"))
    return _pages(spark, sf_dir).select("page_id", F.array_join(found, ",").alias("evidence"))


#: Robots files by the customer's number: a star group, an own group after it, an own group that forbids nothing, only another's group.
_ROBOTS = [
    "# all\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /end$\n",
    "Disallow: /lost\nUser-agent: *\nDisallow: /\n\nUser-agent: x\nUSER-AGENT: LeadLoom # us\nDisallow: /a/b*.pdf\nAllow: /a/b/c\nCrawl-delay: 3\nDisallow: /e\nAllow: /e\n",
    "User-agent: leadloom\r\nDisallow:\r\nUser-agent: *\r\nDisallow: /\r\n",
    "User-agent: otherbot\nDisallow: /\n",
]
_ASKED = ["/", "/a", "/a/b/x", "/a/b/c.html", "/end", "/ends", "/e2", "/b"]


@query(
    "WITH rules(variant, allow, path, written) AS (VALUES (0, false, '/a', 2), (0, true, '/a/b', 4), (1, false, '/a/b', 9), (1, true, '/a/b/c', 6), (1, false, '/e', 2), (1, true, '/e', 2)), "
    f"asked AS (SELECT c_name AS host, c_custkey % 4 AS variant, unnest({_ASKED}) AS path FROM customer), "
    "ranked AS (SELECT a.*, r.allow, row_number() OVER (PARTITION BY a.host, a.path ORDER BY r.written DESC NULLS LAST, r.allow DESC) AS n FROM asked a LEFT JOIN rules r ON r.variant = a.variant AND starts_with(a.path, r.path)) "
    "SELECT host, path, coalesce(allow, true) AND NOT (variant = 0 AND path = '/end') AS allowed FROM ranked WHERE n = 1"
)
def robots_decision(spark, sf_dir):
    """A robots file per customer, eight paths asked of each."""
    c = views.table(spark, sf_dir, "customer")
    files = c.select(F.col("c_name").alias("host"), F.get(F.array(*map(F.lit, _ROBOTS)), (F.col("c_custkey") % 4).cast("int")).alias("robots"))
    paths = c.select(F.col("c_name").alias("host"), F.explode(F.array(*map(F.lit, _ASKED))).alias("path"))
    return web.robots_decision(paths, web.robots_rules(files, "leadloom"))


def _inbound_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_])(?:{'|'.join(signals)})(?:[^A-Za-z0-9_]|$)') THEN '{name}'" for name, signals in catalog.INBOUND_SIGNALS)
    return f"WITH m AS (SELECT conv_id, turn, coalesce(text, '') || CASE conv_id % 6 WHEN 0 THEN ' Please unsubscribe me, how much?' WHEN 1 THEN ' How much is it' WHEN 2 THEN ' send the invoice' WHEN 3 THEN ' requote' WHEN 4 THEN ' solicito cotización por favor' ELSE '' END AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE {cases} ELSE 'unrelated' END AS category FROM m"


def inbound_messages(spark, sf_dir):
    """Messages of users, some with one of the signals at the end."""
    tail = "concat(coalesce(text, ''), CASE conv_id % 6 WHEN 0 THEN ' Please unsubscribe me, how much?' WHEN 1 THEN ' How much is it' WHEN 2 THEN ' send the invoice' WHEN 3 THEN ' requote' WHEN 4 THEN ' solicito cotización por favor' ELSE '' END)"
    return views.messages(spark, sf_dir).selectExpr("conv_id", "turn", f"{tail} AS text")


@query(_inbound_sql())
def inbound_category(spark, sf_dir):
    m = inbound_messages(spark, sf_dir)
    return m.select("conv_id", "turn", segments.inbound_category(F.col("text")).alias("category"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') THEN 'email' END, CASE WHEN regexp_matches(text, '\\b(?:\\+?1[ .-]?)?\\(?\\d{3}\\)?[ .-]\\d{3}[ .-]\\d{4}\\b') THEN 'phone' END, CASE WHEN regexp_matches(text, '-?[0-9]{1,3}\\.[0-9]{5,}') THEN 'coordinate' END, CASE WHEN regexp_matches(text, '(?i)\\bp\\.?\\s?o\\.?\\s*box\\b') THEN 'po_box' END, CASE WHEN regexp_matches(text, '(?i)\\bpmb\\b') THEN 'mailbox' END) AS flags FROM documents")
def pii_flags(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(web.pii_flags(F.col("text")), ",").alias("flags"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\\b(Bearer|Basic)\\s+[A-Za-z0-9._~+/=-]{8,}', '\\1 [REDACTED]', 'g'), '(?i)(\"?(?:authorization|x-api-key|api[_-]?key|token)\"?\\s*[:=]\\s*\"?)[^\"''\\s,}]{8,}', '\\1[REDACTED]', 'g')) AS redacted_md5 FROM documents")
def redact(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    """FN-41 in its order-insensitive form: the hash is the group, copies are counted map-side first."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


#: A title per part, in SQL of both engines.
_TITLE = (
    "concat(CASE p_partkey % 7 WHEN 0 THEN concat(' O', chr(39)) WHEN 1 THEN 'd’' WHEN 2 THEN concat('x', chr(39)) WHEN 3 THEN 'éL ' WHEN 4 THEN concat('L', chr(39), 'Ñ') ELSE '  ' END, "
    "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, CASE p_partkey % 3 WHEN 0 THEN concat(chr(39), 's CAFÉ') WHEN 1 THEN '-BAR & GRILL ' ELSE '2go' END)"
)


@query(
    f"WITH t AS (SELECT p_partkey AS id, regexp_extract_all(lower(trim({_TITLE})), '[\\p{{L}}\\p{{N}}''’]+|[^\\p{{L}}\\p{{N}}''’]+') AS parts FROM part) "
    "SELECT id, array_to_string(list_transform(parts, lambda w: CASE WHEN regexp_matches(w, '^[odl][''’]\\p{L}') THEN upper(w[1]) || w[2] || upper(w[3]) || w[4:] ELSE upper(w[1]) || w[2:] END), '') AS title FROM t"
)
def title_case(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), text.title_case(F.expr(_TITLE)).alias("title"))


#: The owner of each part, in SQL of both engines: the name itself, with a legal form, turned around, with more words, none.
_OWNER = (
    "CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('The ', p_name, ', L.L.C') WHEN 2 THEN concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1)) WHEN 3 THEN concat(p_name, ' owner') "
    "WHEN 4 THEN replace(p_name, 'a', 'á') WHEN 5 THEN split_part(p_name, ' ', 1) END"
)
_OWNED = r"regexp_replace(regexp_replace(strip_accents(lower(trim({0}))), '\b(l\.l\.c|inc|llc|corp|corporation|company|co|ltd|lp|the|and|de|del|la|el|dba)\b', '', 'g'), '[^a-z0-9]', '', 'g')"
_LETTERS = "list_sort(list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^a-z]+'), lambda w: len(w) > 1))"


@query(f"WITH o AS (SELECT p_partkey AS id, p_name AS trade, coalesce({_OWNER}, '') AS owner FROM part) SELECT id, {_OWNED.format('owner')} <> '' AND {_OWNED.format('trade')} <> '' AND ({_OWNED.format('owner')} = {_OWNED.format('trade')} OR ({_LETTERS.format('owner')} = {_LETTERS.format('trade')} AND len({_LETTERS.format('trade')}) > 0)) AS is_owner FROM o")
def owner_names(spark, sf_dir):
    """CLS-13 on part names."""
    p = views.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), keys.is_owner_name(F.col("p_name"), F.coalesce(F.expr(_OWNER), F.lit(""))).alias("is_owner"))


@query("WITH p AS (SELECT s_suppkey % 40 AS site, s_suppkey AS ord, (['alpha', 'beta', 'gamma'])[s_suppkey % 3 + 1] AS product, (s_suppkey % 20) / 20.0::DOUBLE AS confidence FROM supplier), b AS (SELECT *, coalesce(max(confidence) OVER (PARTITION BY site ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT site, arg_max(product, (confidence, -ord)) AS product, max(confidence) AS confidence FROM b WHERE before < 0.85 GROUP BY site")
def crm_fingerprint(spark, sf_dir):
    probes = views.table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 40 AS site", "s_suppkey AS ord", "element_at(array('alpha', 'beta', 'gamma'), cast(s_suppkey % 3 AS int) + 1) AS product", "(s_suppkey % 20) / 20.0D AS confidence")
    return web.crm_fingerprint(probes)
