"""Robots rules and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registers import says

SHARE = 100_000  # paths of a host that one task meets


def robots_rules(files: DataFrame, agent: str, host: str = "host", text: str = "robots") -> DataFrame:
    """host, type, path: the rules of each robots file that hold for the agent.

    Consecutive User-agent lines share a group; the first group that names the agent wins over the
    first with a star. A file is a row, its lines are an array of it: nothing is shuffled. Where a
    host has several files, each is read by itself and the rules of all hold.
    """
    parts = lambda line: F.struct(F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"))
    is_agent = lambda x: x["field"] == "user-agent"
    names = lambda x: is_agent(x) & (x["value"] != "*") & F.contains(F.lit(agent.lower()), F.lower(x["value"])) & (x["value"] != "")
    first = lambda c, holds: F.nullif(F.array_position(F.transform(c, holds), True), F.lit(0)).cast("int")

    lines = F.transform(F.split(F.regexp_replace(text, r"\r", ""), "\n"), lambda line: F.trim(F.regexp_replace(line, r"#.*$", "")))
    fields = F.transform(F.filter(lines, lambda line: F.instr(line, ":") > 0), parts)
    f = files.select(host, F.filter(fields, lambda x: x["field"].isin("user-agent", "allow", "disallow")).alias("lines"))
    starts = lambda x, i: is_agent(x) & (F.coalesce(F.get("lines", i - 1)["field"], F.lit("")) != "user-agent")
    f = f.select(host, F.transform("lines", lambda x, i: x.withField("starts", starts(x, i))).alias("lines"))
    f = f.select(host, "lines", F.coalesce(first("lines", names), first("lines", lambda x: is_agent(x) & (x["value"] == "*"))).alias("at"))
    f = f.select(host, F.slice("lines", F.col("at") + 1, F.size("lines")).alias("lines"))  # what follows the agent's line
    f = f.select(host, F.slice("lines", 1, F.coalesce(first("lines", lambda x: x["starts"]) - 1, F.size("lines"))).alias("lines"))
    rules = f.select(host, F.explode(F.filter("lines", lambda x: ~is_agent(x))).alias("rule"))
    return rules.select(host, F.col("rule.field").alias("type"), F.col("rule.value").alias("path"))


def robots_decision(paths: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """host, path, allowed: the longest rule that matches decides, allow among equals; none: allowed.

    A rule ends at its first star; a final $ asks for the whole path; empty rules match nothing.
    Paths and rules meet in one shuffle and one sort by host, as rows of one table: nothing but the
    counts of hosts is hashed, and a host's equal rules count once. A host of more than SHARE paths
    is dealt to shares by path, its rules go to each. Equal paths lie together in a share.
    All the session's shuffle partitions are kept: rows are short and pack well, so that partitions
    merged by their packed size would be large ones to sort.
    """
    many = paths.groupBy(F.col(host).alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > SHARE)
    many = F.broadcast(many.select("_h", F.expr(f"cast(_n div {SHARE} + 1 AS int)").alias("_shares")))  # at most a row per SHARE paths
    dealt = lambda df: df.join(many, F.col(host) == F.col("_h"), "left").drop("_h")
    asked = dealt(paths.select(host, path))
    asked = asked.where(F.col("_shares").isNull()).unionByName(asked.where(F.col("_shares").isNotNull()).distinct())
    asked = asked.select(host, path, F.pmod(F.xxhash64(path), F.coalesce("_shares", F.lit(1))).cast("int").alias("_share"), F.lit(True).alias("_asked"))
    whole = F.endswith("path", F.lit("$"))
    text = F.when(whole, F.expr("substring(path, 1, length(path) - 1)")).otherwise(F.regexp_replace("path", r"\*.*$", ""))
    rule = F.struct(F.length("path").alias("n"), (F.col("type") == "allow").alias("allow"), whole.alias("whole"), text.alias("text"))
    r = dealt(rules.where(F.col(host).isNotNull() & (F.col("path") != "")).select(host, rule.alias("_rule")))
    r = r.select(host, "_rule", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("_share"), F.lit(False).alias("_asked"))
    rows = asked.unionByName(r, allowMissingColumns=True)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), host, "_share")
    of_host = Window.partitionBy(host, "_share")
    ordered = of_host.orderBy("_asked", path)
    again = F.coalesce(F.lag("_asked").over(ordered), F.lit(False)) & F.lag(path).over(ordered).eqNullSafe(F.col(path))
    rows = rows.withColumn("_again", again).withColumn("_rules", F.collect_set("_rule").over(of_host))
    hits = F.filter("_rules", lambda x: F.when(x["whole"], F.col(path) == x["text"]).otherwise(F.startswith(F.col(path), x["text"])))
    best = F.array_max(F.transform(hits, lambda x: F.struct(x["n"], x["allow"])))
    return rows.where(F.col("_asked") & ~F.col("_again")).select(host, path, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


# Forms of personal data in texts, and names of fields that hold some.
_PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\b(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
    "coordinate": r"-?\d{1,3}\.\d{5,}",
    "po_box": r"\bp\.?\s?o\.?\s*box\b",
    "mailbox": r"\bpmb\b",
}
_PERSONAL_KEY = "owner|contact|phone|email|latitude|longitude|administrator|manager_name|person"


def pii_flags(c: Column) -> Column:
    """Names of the kinds of personal data in a text; words are bounded as ASCII words are."""
    return F.array_compact(F.array(*[F.when(says(c, p, case=k not in ("po_box", "mailbox")), F.lit(k)) for k, p in _PERSONAL.items()]))


def personal_key(name: Column) -> Column:
    """Whether a field's name tells of personal data."""
    return F.coalesce(name.rlike(f"(?i){_PERSONAL_KEY}"), F.lit(False))


def crm_fingerprint(probes: DataFrame, enough: float = 0.85) -> DataFrame:
    """site, product, confidence: the surest product of each site, from probes with an order.

    A probe that reaches `enough` ends the site's probing: later ones don't count.
    """
    w = Window.partitionBy("site").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = probes.withColumn("before", F.coalesce(F.max("confidence").over(w), F.lit(0.0))).where(F.col("before") < enough)
    best = F.max_by(F.struct("product", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")
    return counted.groupBy("site").agg(best).select("site", "b.product", "b.confidence")
