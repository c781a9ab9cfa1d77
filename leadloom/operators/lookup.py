"""Joins with catalogs of any size: ranges by a dyadic cover, keywords by an automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of level k has 2^(BITS k) numbers. More bits: fewer rows a point, more blocks a range.
BITS = 4
#: Blocks for counts, which take a row for a block of points and not for a point.
COUNT_BITS = 2
#: Bytes of keywords that one automaton holds at most; its nodes take about 60 times as much.
KEYWORD_BYTES = 2_000_000


# ---- ranges


def cover(low: Column, high: Column, width: int = BITS) -> Column:
    """Array of (level, block): aligned blocks that don't overlap and whose union is the whole numbers from low to high, ends
    included; null for an empty range or a null end. At most 2 x (2^width - 1) blocks a level."""
    fn = F.call_function
    last = 60 // width

    def on_level(k: Column) -> Column:
        bits, one = k * width, F.lit(1).cast("long")
        lo = fn("shiftright", low.cast("long") + fn("shiftleft", one, bits) - 1, bits)
        hi = fn("shiftright", high.cast("long") + 1, bits)
        # What the next level can take stands between the multiples of 2^width inside.
        inner_lo = F.when(k == last, hi).otherwise(F.least(hi, fn("shiftleft", fn("shiftright", lo + (1 << width) - 1, F.lit(width)), F.lit(width))))
        inner_hi = F.greatest(inner_lo, fn("shiftleft", fn("shiftright", hi, F.lit(width)), F.lit(width)))
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        blocks = F.concat(run(lo, inner_lo), run(inner_hi, hi))
        return F.transform(F.when(lo < hi, blocks).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(k.alias("level"), b.alias("block")))

    # A block within a range isn't longer than it.
    top = sum((((high.cast("long") - low.cast("long")) >= (1 << width * k) - 1).cast("int") for k in range(1, last + 1)), F.lit(0))
    return F.when(low <= high, F.flatten(F.transform(F.sequence(F.lit(0), top), on_level)))


def _blocks(ranges: DataFrame, low: str, high: str, width: int) -> tuple[DataFrame, list[int]]:
    """ranges with a row per block (_level, _block), and the levels that they may use."""
    longest = ranges.agg(F.max(F.col(high).cast("long") - F.col(low).cast("long"))).first()[0]
    levels = [k for k in range(60 // width + 1) if (longest or 0) >= (1 << width * k) - 1]
    # Dealt out before the blocks are made: a table of ranges is one small file often.
    dealt = ranges.repartition(low, high)
    blocks = dealt.withColumn("_b", F.explode(cover(F.col(low), F.col(high), width)))
    return blocks.select(*ranges.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")), levels or [0]


def _probes(points: DataFrame, point: str, levels: list[int], width: int) -> DataFrame:
    at = F.transform(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: F.struct(k.alias("_level"), F.call_function("shiftright", F.col(point).cast("long"), k * width).alias("_block")))
    return points.where(F.col(point).isNotNull()).select("*", F.inline(at))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """points x ranges where low <= point <= high (whole numbers within 2^60 of 0), as an equality join on (level, block).

    A point and a range meet in exactly one block, so a pair comes once however ranges overlap. A point is
    looked up once for each level up to that of the longest range, three or four mostly. Null points match nothing. A block that many points share is one skewed key of a sort-merge join, which AQE splits.
    The join is always a sort-merge join: Spark reckons the blocks to be as small as their ranges and would broadcast them.
    """
    blocks, levels = _blocks(ranges, low, high, BITS)
    return _probes(points, point, levels, BITS).join(blocks.hint("merge"), ["_level", "_block"]).drop("_level", "_block")


def range_counts(points: DataFrame, ranges: DataFrame, by: str, point: str, low: str, high: str) -> DataFrame:
    """(by, n, first): the number and the smallest of the points of the ranges of one `by`, pair by pair as range_join() has them; only ranges that have some.

    Points are counted for each block, level by level, before ranges meet them: what is joined is blocks, not pairs, however many points a range has.
    """
    blocks, levels = _blocks(ranges.select(by, low, high), low, high, COUNT_BITS)
    counted = points.select(F.col(point).cast("long").alias("_low"), F.lit(1).cast("long").alias("_n")).where("_low IS NOT NULL")
    probes = _probes(counted, "_low", levels, COUNT_BITS).groupBy("_level", "_block").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"))
    met = probes.join(blocks.select(by, "_level", "_block").hint("merge"), ["_level", "_block"])
    return met.groupBy(by).agg(F.sum("_n").alias("n"), F.min("_low").alias("first"))


# ---- keywords


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str, text: str, word: str, group_bytes: int = KEYWORD_BYTES) -> DataFrame:
    """(key, word, n): how often each keyword stands in each text, places that overlap included; only those that do.

    One pass over a text for all keywords of an automaton, however many they are. Keywords are counted
    first: as many groups by their hash as keep an automaton within `group_bytes` of keywords are made, and each
    is collected, built and shared with the tasks on its own; every group costs a pass. Blank keywords
    and null texts match nothing; repeated keywords count once; texts of one key are added up.
    """
    words = keywords.select(F.col(word).cast("string").alias("word")).where(F.length("word") > 0).distinct()
    total = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    groups = -(-2 * total // group_bytes) if total > group_bytes else 1
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    out = None
    for g in range(groups):
        some = [r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(groups)) == g).collect()]
        found = rows.mapInArrow(_search(_automaton(some)), f"key {kind}, word string, n bigint") if some else None
        out = found if out is None else out if found is None else out.union(found)
    if out is None:
        out = rows.select("key", F.col("text").alias("word"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return out.groupBy("key", "word").agg(F.sum("n").alias("n")).withColumnsRenamed({"key": key, "word": word})


def _automaton(words: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in enumerate(sorted(words)):
        a.add_word(w, k)
    a.make_automaton()
    return a, sorted(words)


def _search(built):
    automaton, words = built

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, n = [], [], []
            for i, t in enumerate(b.column(1)):
                counts: dict[int, int] = {}
                for _, k in automaton.iter(t.as_py()):
                    counts[k] = counts.get(k, 0) + 1
                at += [i] * len(counts)
                found += [words[k] for k in counts]
                n += counts.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["key", "word", "n"])

    return run
