"""A tabular web service as a Spark data source: pushed filters, key ranges read page by page, and retries."""

from __future__ import annotations

import datetime as dt
import email.utils
import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith
from pyspark.sql.types import BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType, TimestampNTZType, TimestampType

#: Attempts in all, first wait and longest one when the service names none, longest wait it may ask for (seconds).
ATTEMPTS, BASE, CAP, LONGEST_ASKED = 4, 1.0, 30.0, 300.0
#: Column that says, in a range's last row, whether the range was read to its end.
COMPLETE = "_complete"
_NAME = re.compile(r"[A-Za-z_]\w*")


class Throttled(Exception):
    """The service still asks to wait after the last attempt, or for longer than there is time."""


def asked_wait(header: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for: a number or an HTTP date; None if it is neither."""
    raw = (header or "").strip()
    if re.fullmatch(r"\d+(\.\d+)?", raw):
        return float(raw)
    if not re.match(r"[A-Za-z]{3}", raw):
        return None
    try:
        return max(0.0, email.utils.parsedate_to_datetime(raw).timestamp() - now)
    except ValueError:
        return None


@dataclass
class Retry:
    """How a request is repeated: as often and long as the service asks by Retry-After, else with full jitter under a
    doubling bound, within `budget` seconds in all. Only 429, 503 and broken connections are repeated."""

    attempts: int = ATTEMPTS
    base: float = BASE
    cap: float = CAP
    budget: float = 600.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    draw: Callable[[], float] = random.random

    def get(self, url: str, timeout: float = 20.0, opener: Callable | None = None) -> bytes:
        began, answer = self.clock(), ""
        for attempt in range(1, self.attempts + 1):
            header = None
            try:
                with (opener or urllib.request.urlopen)(url, timeout=timeout) as r:  # noqa: S310
                    return r.read()
            except urllib.error.HTTPError as e:
                if e.code not in (429, 503):
                    raise ValueError(f"HTTP {e.code}: {e.read()[:200]!r}") from e
                header, answer = e.headers.get("Retry-After"), f"HTTP {e.code}"
            except (urllib.error.URLError, TimeoutError) as e:
                answer = str(e)
            wait = asked_wait(header, self.clock())
            wait = min(wait, LONGEST_ASKED) if wait is not None else min(self.cap, self.base * 2 ** (attempt - 1)) * self.draw()
            if attempt == self.attempts or self.clock() + wait - began > self.budget:
                break
            self.sleep(wait)
        raise Throttled(f"{answer} after {attempt} attempts (Retry-After: {header}): {url}")


def literal(v) -> str:
    """A value as a literal of the service's query language; quotes are doubled."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float, Decimal)):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return f"'{v.isoformat()}'"
    return "'" + str(v).replace("'", "''") + "'"


def condition(f: Filter) -> str | None:
    """A Spark filter as a condition of the service; None if it has none. Like Spark's, it is not true of nulls."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, EqualTo) and inner.value is not None and (c := _column(inner)):
            return f"{c} != {literal(inner.value)}"
        return None
    c = _column(f)
    if not c:
        return None
    if isinstance(f, IsNull):
        return f"{c} IS NULL"
    if isinstance(f, IsNotNull):
        return f"{c} IS NOT NULL"
    if isinstance(f, In):
        return f"{c} IN ({', '.join(map(literal, f.value))})" if f.value and None not in f.value else None
    if isinstance(f, StringStartsWith):
        return f"starts_with({c}, {literal(f.value)})"
    sign = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
    return f"{c} {sign} {literal(f.value)}" if sign and f.value is not None else None


def _column(f: Filter) -> str | None:
    path = getattr(f, "attribute", ())
    return path[0] if len(path) == 1 and _NAME.fullmatch(path[0]) else None


@dataclass
class Range(InputPartition):
    """Keys above `low` up to `high`; None is no bound."""

    low: object
    high: object


class ServiceReader(DataSourceReader):
    """Pages of every key range, each asked for by the last key seen: rows that come and go between pages are neither
    skipped nor read twice. Only the schema's fields are asked for."""

    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.fields = [f.name for f in schema.fields if f.name != COMPLETE]
        self.url, self.key = options["url"], options["key"]
        self.size, self.pages = int(options.get("pagesize", 1000)), int(options.get("maxpages", 0))
        self.ranges = int(options.get("numpartitions", 8))
        self.splits = json.loads(options["splits"]) if "splits" in options else None
        self.where = [options["where"]] if "where" in options else []
        self.retry = Retry(int(options.get("attempts", ATTEMPTS)), float(options.get("basewait", BASE)), budget=float(options.get("budget", 600)))
        if self.key not in self.fields:
            raise ValueError("the key has to be in the schema")

    def _ask(self, **query) -> list[dict]:
        asked = urllib.parse.urlencode({f"${k}": v for k, v in query.items() if v})
        rows = json.loads(self.retry.get(f"{self.url}?{asked}"))
        if not isinstance(rows, list):
            raise ValueError(f"the service answered with something else than rows: {str(rows)[:200]}")
        return rows

    def partitions(self) -> list[Range]:
        cuts = self.splits
        if cuts is None:
            ends = self._ask(select=f"min({self.key}) AS low, max({self.key}) AS high", where=" AND ".join(self.where))
            low, high = (ends[0].get("low"), ends[0].get("high")) if ends else (None, None)
            whole = isinstance(self.schema[self.key].dataType, (LongType, IntegerType, ShortType, ByteType))
            if low is None or not whole:
                cuts = []
            else:
                low, high = int(low), int(high)
                cuts = sorted({low - 1 + (high - low + 1) * k // self.ranges for k in range(1, self.ranges)} - {low - 1, high})
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        at, flagged = partition.low, COMPLETE in self.schema.fieldNames()
        page, before = 0, None
        while True:
            page += 1
            bounds = [f"{self.key} > {literal(at)}"] if at is not None else []
            bounds += [f"{self.key} <= {literal(partition.high)}"] if partition.high is not None else []
            rows = self._ask(select=", ".join(self.fields), where=" AND ".join(self.where + bounds), order=self.key, limit=self.size)
            if before is not None:
                yield self._row(before, True)
            yield from (self._row(r, True) for r in rows[:-1])
            before = rows[-1] if rows else None
            if len(rows) < self.size:
                break
            at = self._value(rows[-1][self.key], self.schema[self.key].dataType)
            if self.pages and page == self.pages:
                if not flagged:
                    raise ValueError(f"{self.url}: {page} pages of {self.size} don't reach the end of a range; raise maxpages, or read the column {COMPLETE}")
                yield self._row(before, False)
                return
        if before is not None:
            yield self._row(before, True)

    def _row(self, r: dict, complete: bool) -> tuple:
        return tuple(complete if f.name == COMPLETE else self._value(r.get(f.name), f.dataType) for f in self.schema.fields)

    @staticmethod
    def _value(v, kind):
        if v is None:
            return None
        if isinstance(kind, (LongType, IntegerType, ShortType, ByteType)):
            return int(v)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(v)
        if isinstance(kind, DecimalType):
            return Decimal(str(v))
        if isinstance(kind, BooleanType):
            return v if isinstance(v, bool) else str(v).lower() in ("true", "1")
        if isinstance(kind, DateType):
            return dt.date.fromisoformat(v[:10])
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            at = dt.datetime.fromisoformat(v)
            return at if isinstance(kind, TimestampNTZType) or at.tzinfo else at.replace(tzinfo=dt.UTC)
        return v if isinstance(v, str) else json.dumps(v)


class PushedReader(ServiceReader):
    """The reader that also sends filters; Spark asks for a class of its own where sessions don't push any."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            got = condition(f) if _column(getattr(f, "child", f)) in self.fields else None
            if got is None:
                yield f
            else:
                self.where.append(got)


class TabularService(DataSource):
    """spark.dataSource.register(TabularService); spark.read.format("service").schema(...).options(url=..., key=...).load()

    Options: key (a unique column; the order of pages), pagesize, numpartitions or splits (a JSON list of keys),
    maxpages of a range, where (a condition of the service's own), attempts, basewait, budget (seconds).
    Filters are sent to the service, for which the session needs spark.sql.python.filterPushdown.enabled; with the
    option push=false none are. A range that maxpages cuts
    off is an error, unless the schema has the boolean column `_complete`, false in that range's last row.
    """

    @classmethod
    def name(cls) -> str:
        return "service"

    def schema(self) -> str:
        raise ValueError("give a schema: its fields are what is asked for")

    def reader(self, schema: StructType) -> ServiceReader:
        push = self.options.get("push", "true").lower() == "true"
        return (PushedReader if push else ServiceReader)(schema, self.options)
