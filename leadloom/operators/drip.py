"""Scheduled mail as a state machine: enrolment, and ticks that send, defer, retry, cancel or fail due steps.

A tick is one function from the table of steps to the next one, so that a run is a chain of tables, and
a tick repeated on its own result changes nothing that is not due again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import catalog
from . import guards, resolve
from .records import blank

#: Refusals of outbound mail after which a step is tried again; all others end the lead's steps.
PASSING = ("daily_limit_reached", "outbound_disabled")
LATER = 6 * 60
RETRY = 30
STEPS = ["id", "sequence", "step", "position", "scheduled_at", "status", "error"]


def chosen_sequence(explicit: Column, channel: Column, segment: Column) -> Column:
    """The sequence asked for, else outbound for leads of that channel, else commercial or residential by segment."""
    own = F.when(channel == "outbound", "outbound").when(segment == "commercial", "commercial").otherwise("residential")
    return F.when(blank(explicit), own).otherwise(explicit)


def enrolled(existing: DataFrame | None, leads: DataFrame, at: Column) -> DataFrame:
    """The table of steps with those of the leads (id, sequence, contact_channel, segment) added, pending, from `at` on.

    A step that the lead has already, whatever became of it, stays as it is. A sequence that doesn't
    exist gives one row with the status `unknown_sequence` and no step, for the caller to refuse.
    """
    named = leads.select("id", at.alias("at"), chosen_sequence(F.col("sequence"), F.col("contact_channel"), F.col("segment")).alias("sequence"))
    j = named.join(F.broadcast(guards.steps_table(leads.sparkSession)), "sequence", "left")
    known = F.col("step").isNotNull()
    when = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce("delay", F.lit(0)))
    new = j.select("id", "sequence", "step", "position", F.when(known, when).alias("scheduled_at"), F.when(known, "pending").otherwise("unknown_sequence").alias("status"), F.lit(None).cast("string").alias("error"))
    return new if existing is None else resolve.insert_ignore(existing.select(STEPS), new, ["id", "sequence", "step"], "scheduled_at")


def tick(steps: DataFrame, now: str, refusal: Column, mail_error: Column, limit: int | None = None) -> DataFrame:
    """steps after a tick at `now` (UTC), with `outcome`: sent, skipped, deferred, failed, or null where nothing was due.

    steps has STEPS and the lead's `unsubscribed` and `lead_status`. refusal is the reason that stops an
    outbound mail now, mail_error what a delivery answers; null where all is well. With a limit only the
    first steps by time are due, ties by lead, sequence and position. A lead's other pending steps are cancelled with its step
    when an outbound mail is refused for good.
    """
    at = F.lit(dt.datetime.fromisoformat(now)).cast("timestamp_ntz")
    c = F.col
    is_due = F.coalesce((c("status") == "pending") & (c("scheduled_at") <= at), F.lit(False))
    if limit is None:
        marked = steps.withColumn("_due", is_due)
    else:
        first = steps.where(is_due).orderBy("scheduled_at", "id", "sequence", "position").limit(limit)
        first = first.select(*[c(k).alias(f"_{k}") for k in ("id", "sequence", "step")], F.lit(True).alias("_due"))
        marked = steps.join(first, (c("id") == c("_id")) & (c("sequence") == c("_sequence")) & (c("step") == c("_step")), "left").drop("_id", "_sequence", "_step")
        marked = marked.withColumn("_due", F.coalesce("_due", F.lit(False)))
    stopped = c("unsubscribed") | F.coalesce(c("lead_status").isin(catalog.STOP_STATUSES), F.lit(False))
    outbound = c("sequence") == "outbound"
    refused = F.when(outbound, refusal)
    act = (
        F.when(~c("_due"), None)
        .when(stopped, "stop")
        .when(~guards.in_send_hours(at) & (c("step") != "quote"), "wait")
        .when(refused.isin(*PASSING), "later")
        .when(refused.isNotNull(), "refuse")
        .when(mail_error.isNull(), "send")
        .when(c("error").startswith("retry:"), "fail")
        .otherwise("retry")
    )
    marked = marked.withColumn("_act", act).withColumn("_why", F.when(act.isin("later", "refuse"), refused).when(act.isin("fail", "retry"), mail_error))
    lead = Window.partitionBy("id")  # a lead has a few steps
    ended = F.max(F.when(c("_act") == "refuse", c("_why"))).over(lead)
    marked = marked.withColumn("_ended", ended)
    open_still = (c("status") == "pending") & (c("_act").isNull() | c("_act").isin("wait", "later", "retry"))
    a, minutes = c("_act"), lambda m: at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    status = (
        F.when(a.isin("stop", "refuse") | (c("_ended").isNotNull() & open_still), "cancelled").when(a == "send", "sent").when(a == "fail", "failed").otherwise(c("status"))
    )
    error = (
        F.when(a == "stop", F.when(c("unsubscribed"), "unsubscribed").otherwise(F.concat(F.lit("lead_status:"), "lead_status")))
        .when(a == "refuse", c("_why"))
        .when(c("_ended").isNotNull() & open_still, c("_ended"))
        .when(a == "later", F.concat(F.lit("deferred:"), "_why"))
        .when(a == "retry", F.concat(F.lit("retry:"), "_why"))
        .when(a == "fail", c("_why"))
        .otherwise(c("error"))
    )
    when = F.when(a == "later", minutes(LATER)).when(a == "retry", minutes(RETRY)).otherwise(c("scheduled_at"))
    outcome = F.when(a.isin("stop", "refuse"), "skipped").when(a == "send", "sent").when(a == "fail", "failed").when(a.isNotNull(), "deferred")
    out = marked.select("*", status.alias("_status"), error.alias("_error"), when.alias("_when"), outcome.alias("_outcome"))
    kept = [k for k in steps.columns if k not in ("status", "error", "scheduled_at", "outcome")]
    return out.select(*kept, c("_when").alias("scheduled_at"), c("_status").alias("status"), c("_error").alias("error"), c("_outcome").alias("outcome"))
