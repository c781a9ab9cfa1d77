"""Leads and companies as other systems keep them: intake, selection, equality by field, patches, quotas and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import email_status, phone, valid_date
from ..functions.text import clean
from ..plans import catalog

# Lengths that fields of a form are cut to, and the shortest time that a person needs for it.
FORM_FIELDS = {"name": 120, "address": 220, "message": 1500, "landing_page": 400, "referrer": 400, "utm_source": 120, "utm_medium": 120, "utm_campaign": 160, "utm_term": 160, "utm_content": 160, "gclid": 200, "fbclid": 200}
FAST_MILLIS = 3000
# The window of a durable quota, and how far ahead another clock may be.
QUOTA_HOURS, SKEW_MINUTES = 24, 5
# Statuses that end the automation of a lead when somebody sets them.
TERMINAL = ["won", "lost", "booked", "spam"]


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def intake(forms: DataFrame) -> DataFrame:
    """Rows of a form as leads: all text cut, mail, phone and date normalized, `fast` marked; rejected ones have a `reject`.

    A filled company_website is a trap for robots: the row goes without a word. A form that was filled
    too fast stays, marked. Columns that the form lacks are empty.
    """
    have = lambda name: F.col(name) if name in forms.columns else F.lit("")
    real = forms.where(blank(have("company_website")))
    elapsed = F.coalesce(have("form_time_ms").try_cast("long"), F.lit(0))
    return real.select(
        "id",
        F.lower(clean(have("email"), 190)).alias("email"),
        F.when(email_status(have("email")) != "valid", "invalid_email").alias("reject"),
        phone(have("phone")).alias("phone"),
        valid_date(have("preferred_date")).alias("preferred_date"),
        F.coalesce(F.nullif(clean(have("source"), 60), F.lit("")), F.lit("widget")).alias("source"),
        *[clean(have(f), n).alias(f) for f, n in FORM_FIELDS.items()],
        ((elapsed > 0) & (elapsed < FAST_MILLIS)).alias("fast"),
    )


def prospect_page(prospects: DataFrame, stage: str = "", segment: str = "", source: str = "", text: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of prospects by score and age, newest first, each row with the number of all that match."""
    for column, value in (("stage", stage), ("segment", segment), ("source", source)):
        if value:
            prospects = prospects.where(F.col(column) == value)
    if text:
        hit = [F.coalesce(F.col(f), F.lit("")).ilike(f"%{text[:60]}%") for f in ("business_name", "email", "website", "zip")]
        prospects = prospects.where(hit[0] | hit[1] | hit[2] | hit[3])
    number = prospects.agg(F.count("*").alias("total"))
    page = prospects.orderBy(F.desc("icp_score"), F.desc("created_at"), "id").offset(offset).limit(min(limit, 500))
    return page.join(F.broadcast(number))  # one row


def selected(prospects: DataFrame, limit: int) -> DataFrame:
    """The prospects worth sending on: with a key and a name, in a stage past discovery, best first."""
    ok = ~blank(F.col("dedupe_key")) & ~blank(F.col("business_name")) & F.col("stage").isin("enriched", "qualified", "contacted")
    return prospects.where(ok).orderBy(F.desc("icp_score"), F.desc("updated_at"), "id").limit(limit)


def before_cursor(df: DataFrame, prefix: str, cursor: int, limit: int) -> DataFrame:
    """The next rows of one key namespace below an exclusive cursor, newest first."""
    return df.where(F.col("key").startswith(f"{prefix}:") & (F.col("id") < cursor)).orderBy(F.desc("id")).limit(limit)


def namespace_state(companies: DataFrame) -> DataFrame:
    """namespace, lowest_key, latest_key, last_verified: the lowest key of all, and the active row verified last.

    Rows with deleted_at have no say in the second; a tie goes to the larger key.
    """
    space = F.split_part("key", F.lit(":"), F.lit(1)).alias("namespace")
    active = F.col("deleted_at").isNull() & F.col("last_verified").isNotNull()
    latest = F.max(F.when(active, F.struct("last_verified", "key")))
    return companies.groupBy(space).agg(F.min("key").alias("lowest_key"), latest.alias("m")).select("namespace", "lowest_key", F.col("m.key").alias("latest_key"), F.col("m.last_verified").alias("last_verified"))


def durable_quota(state: DataFrame, now: str) -> DataFrame:
    """state (namespace, known, last_verified) with allowed and reason; what can't be told is not allowed."""
    seconds = F.timestamp_diff("SECOND", F.col("last_verified"), F.lit(now).cast("timestamp_ntz"))
    reason = (
        F.when(~F.col("known"), F.lit(None).cast("string"))
        .when(F.col("last_verified").isNull(), "undetermined")
        .when(seconds < -60 * SKEW_MINUTES, "undetermined")
        .when(seconds < 3600 * QUOTA_HOURS, "within_24h")
    )
    return state.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def resolved_cursor(df: DataFrame) -> DataFrame:
    """df (local, crm_configured, crm_ok, crm_key, namespace, bootstrap_allowed) with mode, cursor and origin.

    The local cursor first, then the one the CRM's lowest key gives, then a first run where that is
    allowed; else blocked.
    """
    c = F.col
    own = c("crm_key").startswith(F.concat(c("namespace"), F.lit(":")))
    local, asked = ~blank(c("local")), c("crm_configured")
    mode = (
        F.when(local, "incremental")
        .when(asked & ~c("crm_ok"), "blocked")
        .when(asked & blank(c("crm_key")), "bootstrap")
        .when(asked & ~own, "blocked")
        .when(asked, "incremental")
        .when(c("bootstrap_allowed"), "bootstrap")
        .otherwise("blocked")
    )
    cursor = F.when(local, c("local")).when(asked & c("crm_ok") & own, F.expr("substring(crm_key, length(namespace) + 2)"))
    return df.withColumn("mode", mode).withColumn("cursor", cursor).withColumn("origin", F.when(local, "local").when(asked, "crm").otherwise("none"))


def same_value(kind: str, old: Column, new: Column) -> Column:
    """Whether a proposed value is what is there: links but for slashes at the end, mails whatever the case, parts of an
    address blank or null alike, instants by time, all else trimmed. A null proposal is none: the same."""
    t = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    if kind == "link":
        same = F.regexp_replace(t(old), "/+$", "") == F.regexp_replace(t(new), "/+$", "")
    elif kind == "email":
        same = F.lower(t(old)) == F.lower(t(new))
    elif kind == "address":
        return new.isNull() | (t(old) == t(new))
    elif kind == "instant":
        same = old.try_cast("timestamp").eqNullSafe(new.try_cast("timestamp")) & new.try_cast("timestamp").isNotNull()
    else:
        same = t(old) == t(new)
    return new.isNull() | (old.isNotNull() & same)


def further_mails(primary: Column, others: Column) -> Column:
    """Distinct further addresses in lower case, none without a primary one."""
    low = F.array_distinct(F.filter(F.transform(others, lambda e: F.lower(F.trim(e))), lambda e: e != ""))
    return F.when(blank(primary), F.array().cast("array<string>")).otherwise(low)


def patched(leads: DataFrame, patches: DataFrame) -> DataFrame:
    """leads after patches (id, new_status, new_notes, new_owner; one per id) with `event` where the status was set and `cancel`.

    Blank statuses and owners and null notes change nothing; unknown statuses are refused with their patch.
    """
    known = ["new", "engaged", "quoted", "booked", "won", "lost", "customer", "spam"]
    ok = patches.where(blank(F.col("new_status")) | F.col("new_status").isin(known))
    j = leads.join(ok, "id", "left")
    status = F.when(~blank(F.col("new_status")), F.col("new_status"))
    return j.select(
        "id",
        F.coalesce(status, "status").alias("status"),
        F.coalesce(clean_or_null(F.col("new_notes"), 4000), "notes").alias("notes"),
        F.coalesce(F.when(~blank(F.col("new_owner")), clean(F.col("new_owner"), 80)), "owner").alias("owner"),
        F.when(status.isNotNull(), F.concat(F.col("status"), F.lit(">"), status)).alias("event"),
        F.when(status.isin(TERMINAL), F.concat(F.lit("status:"), status)).alias("cancel"),
    )


def clean_or_null(c: Column, most: int) -> Column:
    return F.when(c.isNotNull(), clean(c, most))


def cancelled(steps: DataFrame, reasons: DataFrame) -> DataFrame:
    """steps (id, step, state) with the pending ones of every lead in reasons (id, reason; one per id) cancelled."""
    j = steps.join(reasons, "id", "left")
    hit = (F.col("state") == "pending") & F.col("reason").isNotNull()
    return j.select("id", "step", F.when(hit, "cancelled").otherwise(F.col("state")).alias("state"), F.when(hit, F.col("reason")).alias("reason"))


def unexpired(hits: DataFrame, now: str, minutes: int) -> DataFrame:
    """Rate-limit rows whose window hasn't ended."""
    return hits.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def either_key(df: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with any of the keys in the index: one semi-join per key, each row once. df has a unique `id`."""
    out = None
    for k in keys:
        hit = df.join(index.select(k).distinct(), k, "left_semi").select(*df.columns)
        out = hit if out is None else out.union(hit)
    return out.dropDuplicates(["id"])


def draft(category: Column) -> tuple[Column, Column]:
    """(template, why none): answers are drafted for some categories only, and never sent."""
    template, why = F.lit(None).cast("string"), F.lit("no_template")
    for name, title in catalog.DRAFTS.items():
        template = F.when(category == name, title).otherwise(template)
    for name, reason in catalog.NO_DRAFT.items():
        why = F.when(category == name, reason).otherwise(why)
    return template, F.when(template.isNull(), why)


def days_since(day: Column, now: str) -> Column:
    """Whole days since a date's midnight, none before it."""
    start = F.try_to_date(F.substring(day.cast("string"), 1, 10)).cast("timestamp_ntz")
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", start, F.lit(now).cast("timestamp_ntz")) / 86400)).cast("int")


def days_until(day: Column, now: str) -> Column:
    """Days to a date's noon, rounded up."""
    noon = F.try_to_date(day.cast("string")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))
    return F.ceil(F.timestamp_diff("SECOND", F.lit(now).cast("timestamp_ntz"), noon) / 86400).cast("int")
