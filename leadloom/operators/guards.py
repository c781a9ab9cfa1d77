"""What may be sent, when: suppression, cool-down, warm-up, send hours, and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contact import email_domain
from ..plans import catalog

#: Parts of a cool-down's days.
PARTS = 16


def suppressed_by(df: DataFrame, suppression: DataFrame, email: str = "email") -> DataFrame:
    """df with suppressed_by: email, domain, no_email or null. suppression has kind and value, unique together."""
    by = suppression.select("kind", F.lower("value").alias("value")).distinct()
    mails = by.where("kind = 'email'").select(F.col("value").alias("_e"))
    domains = by.where("kind = 'domain'").select(F.col("value").alias("_d"))
    j = df.join(mails, F.lower(email) == F.col("_e"), "left").join(domains, email_domain(F.col(email)) == F.col("_d"), "left")
    reason = F.when(F.coalesce(F.col(email), F.lit("")) == "", "no_email").when(F.col("_e").isNotNull(), "email").when(F.col("_d").isNotNull(), "domain")
    return j.withColumn("suppressed_by", reason).drop("_e", "_d")


def recently_contacted(sends: DataFrame, days: int = catalog.COOLDOWN_DAYS, key: str = "domain", ts: str = "ts") -> DataFrame:
    """sends with `recent`: how many of the key's other sends lie in the days before each; 0 for one without a time, which counts for none.

    Rows meet by key and a PARTS-th of the days, so that a key however large is spread over time. Of the whole parts
    before a row only the counts are taken; of the part in which its days begin, what has expired by its time is
    taken off, for which each row comes once more when its days end.
    """
    span = days * 86_400_000_000
    width = span // PARTS
    sends = sends.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = sends.withColumn("_part", F.expr(f"floor(_t / {width})").cast("long")).withColumn("_own", F.lit(True))
    timed = rows.where("_t IS NOT NULL")
    counts = timed.groupBy(key, "_part").agg(F.count("*").alias("n"))
    # Parts without a row of their own are asked for, too: a row may be the first of its part.
    before = Window.partitionBy(key).orderBy("_part").rangeBetween(-PARTS, -1)
    counts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    expiring = timed.withColumns({"_part": F.col("_part") + PARTS, "_t": F.col("_t") + span, "_own": F.lit(False)})
    sofar = Window.partitionBy(key, "_part").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    both = timed.union(expiring).withColumn("_change", F.sum(F.when(F.col("_own"), 1).otherwise(-1)).over(sofar)).where("_own")
    j = both.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    recent = j.withColumn("recent", F.coalesce("_change", F.lit(0)) + F.col("_before"))
    names = [c for c in sends.columns if c != "_t"]
    return recent.select(*names, "recent").union(rows.where("_t IS NULL").select(*names, F.lit(0).cast("long")))


def allowance(day: Column, start: str | None, limit: int = catalog.DAILY_LIMIT) -> Column:
    """Mails that a day allows: a ramp from the start date on, the limit without one."""
    if start is None:
        return F.lit(limit)
    return F.least(F.lit(limit), catalog.WARMUP_START + catalog.WARMUP_STEP * F.greatest(F.lit(0), F.datediff(day, F.lit(start).cast("date"))))


def within_budget(queue: DataFrame, start: str | None, *order: Column, key: str = "id", limit: int = catalog.DAILY_LIMIT) -> DataFrame:
    """queue (with a date `day` and a unique key) with `sent`: whether the row is within its day's allowance.

    No day sends more than `limit`, so each task keeps that many rows of a day at most before they
    meet; only their keys are joined back.
    """
    rank = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    first = queue.withColumn("_rank", rank).where(F.col("_rank") <= limit)
    first = first.where(F.col("_rank") <= allowance(F.col("day"), start, limit)).select(key, F.lit(True).alias("_sent"))
    return queue.join(first, key, "left").withColumn("sent", F.coalesce("_sent", F.lit(False))).drop("_sent")


def in_send_hours(ts: Column, zone: str = "America/Los_Angeles", first: int = 8, last: int = 20) -> Column:
    """Whether the local hour of a UTC time lies in [first, last)."""
    hour = F.hour(F.from_utc_timestamp(ts.cast("timestamp"), zone))
    return (hour >= first) & (hour < last)


def steps_table(spark) -> DataFrame:
    """sequence, step, delay_minutes: as many rows as the catalog has steps."""
    rows = F.array(*[F.struct(F.lit(s).alias("sequence"), F.lit(name).alias("step"), F.lit(k).alias("position"), F.lit(m).alias("delay")) for s, steps in catalog.SEQUENCES.items() for k, (name, m) in enumerate(steps)])
    return spark.range(1).select(F.inline(rows))


def enrol(leads: DataFrame) -> DataFrame:
    """A row per lead and step of its segment's sequence, with its time."""
    steps = F.broadcast(steps_table(leads.sparkSession))
    j = leads.join(steps, leads["segment"] == steps["sequence"])
    at = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("delay"))
    return j.select("id", "segment", "status", "created_at", "step", "position", at.alias("scheduled_at"))


def due(steps: DataFrame, as_of: str, unsubscribed: Column) -> DataFrame:
    """Due steps with what happens to them: cancel, defer (scheduled again after send hours begin), or send."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stopped = unsubscribed | F.col("status").isin(catalog.STOP_STATUSES)
    first_quote = (F.col("step") == "quote") & (F.col("position") == 0)
    action = F.when(stopped, "cancel").when(~in_send_hours(now) & ~first_quote, "defer").otherwise("send")
    return steps.where(F.col("scheduled_at") <= now).withColumn("action", action)


def guard_cascade(df: DataFrame) -> Column:
    """First reason that stops a mail, null if it may go: columns enabled, suppressed_by, unsubscribed, recent, sent, has_mx."""
    c = F.col
    return (
        F.when(~c("enabled"), "outbound_disabled")
        .when(c("suppressed_by").isNotNull(), "suppressed")
        .when(c("unsubscribed"), "unsubscribed")
        .when(c("recent") > 0, "domain_recently_contacted")
        .when(~c("sent"), "daily_limit_reached")
        .when(~c("has_mx"), "no_mx")
    )
