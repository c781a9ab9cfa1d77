"""Rules where a row's outcome depends on the outcomes before it: anchored windows and quotas.

Keys of up to SMALL rows, mostly all, are folded as sorted arrays, one each. For a larger key: a window
or a consumed run is followed by the first row that lies far enough behind it, so the rows that begin one form
a chain through the key's rows. Every row gets a pointer to where the chain would go on from it, and
pointers are followed by doubling: after k rounds they skip 2^k links. So no task holds a large
key, and the number of rounds grows with the logarithm of the longest chain. Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, observed, written
from .ordered import carried, placed, ranged, run_on

#: Rows of a key that are folded as one array at most.
SMALL = 512


@dataclass
class AnchoredWindow:
    """The window of one key as a stream's state keeps it: its start and how many of its hits went through."""

    limit: int
    seconds: int
    start: int | None = None
    count: int = 0

    def hit(self, micros: int) -> bool:
        if self.start is None or micros - self.start > self.seconds * 1_000_000:
            self.start, self.count = micros, 1
            return True
        if self.count >= self.limit:
            return False
        self.count += 1
        return True


def _chain(points: DataFrame, micros: int, closed: bool) -> DataFrame:
    """Of points (key, t, at; `at` numbers them in their order) those that the chains of their keys go through.

    A chain begins at its key's first point and goes on at the first point more than `micros` after
    (`closed`: at least). Repeated and null keys need nothing special: null is a key like any other.
    """
    # A probe stands behind (closed: before) the points of its time; the next point after it is where the chain goes on.
    own = points.select("key", "t", F.lit(1).alias("side"), "at", F.struct("key", "at").alias("target"))
    probes = points.select("key", (F.col("t") + micros).alias("t"), F.lit(0 if closed else 2).alias("side"), "at", F.lit(None).cast(own.schema["target"].dataType).alias("target"))
    found = carried(own.unionByName(probes), F.col("target"), "key", "t", "side", "at", name="next", following=True).where("side <> 1")
    first = points.groupBy("key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("marked"))
    links = found.select("at", F.when(F.col("next.key").eqNullSafe(F.col("key")), F.col("next.at")).alias("next"))
    open_links = F.count("next").alias("n")
    links, left = observed(links.join(first, "at", "left").select("at", "next", F.coalesce("marked", F.lit(False)).alias("marked")), open_links)
    while left["n"]:
        far = links.where("next IS NOT NULL").select(F.col("at").alias("next"), F.col("next").alias("further"))
        reached = links.where("marked AND next IS NOT NULL").select(F.col("next").alias("at"), F.lit(True).alias("reached")).distinct()
        moved = links.join(far, "next", "left").join(reached, "at", "left")
        spent = links
        links, left = observed(moved.select("at", F.col("further").alias("next"), (F.col("marked") | F.coalesce("reached", F.lit(False))).alias("marked")), open_links)
        dropped(spent)
    return links.where("marked").select("at")


def _rows(df: DataFrame, key: str, ts: str, row_id: str, flag: str = "true") -> DataFrame:
    return df.selectExpr(f"{key} AS key", f"unix_micros(cast({ts} AS timestamp)) AS t", f"{row_id} AS id", f"coalesce({flag}, false) AS flag")


def _folded(rows: DataFrame, start: str, allowed: str, after: str) -> DataFrame:
    """(id, key, allowed) by a fold over each key's sorted rows h with the state s: seen, start, n and what came out."""
    of = rows.schema["id"].dataType.simpleString()
    step = f"named_struct('seen', true, 'start', {start}, 'n', {after}, 'out', array_append(s.out, named_struct('id', h.id, 'allowed', {allowed})))"
    none = f"named_struct('seen', false, 'start', cast(null AS bigint), 'n', 0L, 'out', cast(array() AS array<struct<id: {of}, allowed: boolean>>))"
    keys = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "id", "flag"))).alias("hits"))
    # array_sort puts null fields first, as the other way's order does.
    return keys.selectExpr("key", f"inline(reduce(hits, {none}, (s, h) -> {step}, s -> s.out))").select("id", "key", "allowed")


def _split(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of keys with up to `small` rows, and those of all others, if there are any."""
    hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > small).select(F.col("key").alias("hot")))
    if hot.isEmpty():
        return rows, None
    same = F.col("key").eqNullSafe(F.col("hot"))
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def _latest(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with `start`, the (key, t, at) of the last chain point at or before each."""
    marked = rows.join(starts.withColumn("on", F.lit(True)), "at", "left")
    return run_on(marked, F.when(F.col("on"), F.struct("key", "t", "at")), "start")


def anchored(df: DataFrame, key: str, ts: str, row_id: str, limit: int, seconds: int, small: int = SMALL) -> DataFrame:
    """(row_id, key, allowed): of each window's hits the first `limit` are allowed.

    A key's window begins with the first hit more than `seconds` after the last window's begin; hits
    are taken in the order of ts and row_id, which has to be unique. A null key is a key like any other; a
    key's rows without a time come first and share one window.
    """
    micros = seconds * 1_000_000
    fresh = f"(NOT s.seen OR (s.start IS NULL AND h.t IS NOT NULL) OR coalesce(h.t - s.start > {micros}, false))"
    few, many = _split(_rows(df, key, ts, row_id), small)
    out = _folded(few, f"if({fresh}, h.t, s.start)", f"({fresh} AND {limit} > 0) OR (NOT {fresh} AND s.n < {limit})", f"if({fresh}, 1L, s.n + 1)")
    if many is not None:
        rows = placed(ranged(many, "key", "t", "id"), "at")
        last = _latest(rows, _chain(rows.select("key", "t", "at"), micros, False))
        out = out.union(last.select("id", "key", F.col("at") - F.col("start.at") < limit))
    return out.withColumnsRenamed({"id": row_id, "key": key})


def elapsed(df: DataFrame, key: str, ts: str, row_id: str, seconds: int, flag: str, small: int = SMALL) -> DataFrame:
    """(row_id, key, allowed): a run is allowed once `seconds` (over 0) have passed since the last allowed one that was consumed.

    `flag` says in SQL which runs are consumed if allowed; its null is false. Order and keys as in
    anchored(); runs without a time are allowed and consume nothing.
    """
    if seconds <= 0:
        raise ValueError("seconds has to be positive")
    micros = seconds * 1_000_000
    free = f"(s.start IS NULL OR h.t IS NULL OR h.t - s.start >= {micros})"
    few, many = _split(_rows(df, key, ts, row_id, flag), small)
    out = _folded(few, f"if({free} AND h.flag AND h.t IS NOT NULL, h.t, s.start)", free, "0L")
    if many is not None:
        rows = placed(ranged(many, "key", "t", "id"), "at")
        last = _latest(rows, _chain(rows.where("flag AND t IS NOT NULL").select("key", "t", "at"), micros, True))
        start = F.col("start")
        held = start["key"].eqNullSafe(F.col("key")) & (start["at"] < F.col("at")) & (F.col("t") - start["t"] < micros)
        out = out.union(last.select("id", "key", ~F.coalesce(start.isNotNull() & held, F.lit(False))))
    return out.withColumnsRenamed({"id": row_id, "key": key})
