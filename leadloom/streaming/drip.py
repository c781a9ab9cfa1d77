"""Scheduled mail as a stream: enrolments and facts come in, timers fire at ticks, outcomes go out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.drip import LATER, PASSING, RETRY
from ..plans import catalog

OUTCOMES = "id long, sequence string, step string, at timestamp, outcome string, status string, error string"
_MINUTE = 60_000


class DripMachine(StatefulProcessor):
    """State of one lead: its steps by (sequence, step), whether it unsubscribed, its status, and the last tick it has seen.

    A step is judged at the first tick at or after its time; ticks are `every` minutes apart. What a tick does
    is what operators.drip.tick() does to a table. A lead without pending steps keeps them for
    `keep` minutes, so that a repeated enrolment still finds them; then all its state is deleted.
    """

    def __init__(self, refusal: Callable, mail_error: Callable, every: int, keep: int, zone: str = "America/Los_Angeles", hours: tuple[int, int] = (8, 20)):
        self.refusal, self.mail_error, self.every, self.keep, self.zone, self.hours = refusal, mail_error, every * _MINUTE, keep * _MINUTE, zone, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "sequence string, step string", "position int, scheduled long, status string, error string")
        self.facts = handle.getValueState("facts", "unsubscribed boolean, status string")
        self.clock = handle.getValueState("clock", "tick long")

    def _tick(self, millis: int) -> int:
        """The first tick at or after a time."""
        return -(-millis // self.every) * self.every

    def _open(self, millis: int) -> bool:
        return self.hours[0] <= dt.datetime.fromtimestamp(millis / 1000, ZoneInfo(self.zone)).hour < self.hours[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.kind == "fact":
                    before = self.facts.get() if self.facts.exists() else (False, None)
                    status = before[1] if pd.isna(r.lead_status) else r.lead_status
                    self.facts.update((bool(before[0] or r.unsubscribed), status))
                elif not self.steps.containsKey((r.sequence, r.step)):  # insert or ignore
                    at = int(r.scheduled_at.value // 1_000_000)
                    self.steps.updateValue((r.sequence, r.step), (int(r.position), at, "pending", None))
                    self.handle.registerTimer(max(self._tick(at), self._tick(now + 1)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All ticks from the timer's to the watermark, one after the other; timers of ticks that are over do nothing."""
        now, seen, out = expiredTimerInfo.getExpiryTimeInMs(), self.clock.get()[0] if self.clock.exists() else -1, []
        while now is not None and now > seen:
            out += self._judge(int(key[0]), now)
            seen, now = now, self._next(now)
            if now is None:
                for state in (self.steps, self.facts, self.clock):
                    state.clear()
            elif now > timerValues.getCurrentWatermarkInMs():
                self.clock.update((seen,))
                self.handle.registerTimer(now)
                break
        if out:
            yield pd.DataFrame(out, columns=["id", "sequence", "step", "at", "outcome", "status", "error"])

    def _next(self, now: int) -> int | None:
        """The tick after `now` at which there is something to do; None if the lead's time is over."""
        steps = [v for _, v in self.steps.iterator()]
        left = [v[1] for v in steps if v[2] == "pending"]
        if left:
            return max(self._tick(min(left)), now + self.every)
        over = self._tick(max((v[1] for v in steps), default=now) + self.keep)
        return over if over > now else None

    def _judge(self, lead: int, now: int) -> list[tuple]:
        """A tick: what becomes of the lead's due steps, and of its others if outbound mail is refused for good."""
        steps = dict(self.steps.iterator())
        unsubscribed, lead_status = self.facts.get() if self.facts.exists() else (False, None)
        pending = [k for k, v in steps.items() if v[2] == "pending"]
        outcomes: dict[tuple, str | None] = {}
        ended = None
        for k in (k for k in pending if steps[k][1] <= now):
            (sequence, step), (position, at, status, error) = k, steps[k]
            refused = self.refusal(lead, sequence, step, position, now) if sequence == "outbound" else None
            answer = self.mail_error(lead, sequence, step, position, now)
            outcomes[k] = "deferred"
            if unsubscribed or lead_status in catalog.STOP_STATUSES:
                status, error, outcomes[k] = "cancelled", "unsubscribed" if unsubscribed else f"lead_status:{lead_status}", "skipped"
            elif not self._open(now) and step != "quote":
                pass
            elif refused in PASSING:
                at, error = now + LATER * _MINUTE, f"deferred:{refused}"
            elif refused:
                status, error, outcomes[k], ended = "cancelled", refused, "skipped", max(ended or "", refused)
            elif answer is None:
                status = outcomes[k] = "sent"
            elif (error or "").startswith("retry:"):
                status = outcomes[k] = "failed"
                error = answer
            else:
                at, error = now + RETRY * _MINUTE, f"retry:{answer}"
            steps[k] = (position, at, status, error)
        for k in pending:
            if ended and steps[k][2] == "pending":
                steps[k] = (*steps[k][:2], "cancelled", ended)
                outcomes.setdefault(k, None)
        for k in outcomes:
            self.steps.updateValue(k, steps[k])
        return [(lead, *k, pd.Timestamp(now, unit="ms"), o, *steps[k][2:]) for k, o in outcomes.items()]

    def close(self) -> None:
        pass


def drip(inputs: DataFrame, machine: DripMachine, late: str = "0 seconds") -> DataFrame:
    """OUTCOMES of a stream of inputs: id, kind (`step` or `fact`), ts, and the fields of a step (sequence, step, position,
    scheduled_at) or of a fact (unsubscribed, lead_status).

    The watermark of ts drives the ticks. The session has to use the RocksDB state store, as transformWithState asks.
    """
    timed = inputs.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(machine, OUTCOMES, "Append", "EventTime")
