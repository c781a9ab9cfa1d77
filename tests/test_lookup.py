"""Range joins and keyword automata against brute force."""

import random

from leadloom.operators import lookup


def test_range_join_equals_comparing_all(spark):
    rng = random.Random(4)
    points = [(k, rng.choice([rng.randint(-3000, 3000), rng.randint(-(2**59), 2**59), None])) for k in range(300)] + [(900, -1), (901, 0)]
    ranges = [(k, a, a + rng.choice([0, 1, 15, 16, 17, 700, 2**40, -1])) for k, a in enumerate(rng.randint(-3000, 3000) for _ in range(150))]
    ranges += [(900, -(2**59), 2**59), (901, None, 5), (902, 5, None), (903, 0, 0), (904, -16, 15), (905, -(2**60) + 1, -5)]
    got = lookup.range_join(spark.createDataFrame(points, "id int, at long"), spark.createDataFrame(ranges, "range int, low long, high long"), "at", "low", "high")
    want = [(p, r) for p, at in points for r, lo, hi in ranges if None not in (at, lo, hi) and lo <= at <= hi]
    assert sorted((r["id"], r["range"]) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_blocks_of_ranges_are_never_broadcast(spark):
    points, ranges = spark.range(50).withColumnRenamed("id", "at"), spark.range(20).selectExpr("id AS range", "id AS low", "id + 900 AS high")
    for out in (lookup.range_join(points, ranges, "at", "low", "high"), lookup.range_counts(points, ranges, "range", "at", "low", "high")):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()


def test_range_counts_are_those_of_the_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice([rng.randint(-3000, 3000), rng.randint(-(2**59), 2**59), None]),) for _ in range(300)] + [(5,)] * 3
    ranges = [(k % 40, a, a + rng.choice([0, 1, 15, 16, 17, 700, 2**40, -1])) for k, a in enumerate(rng.randint(-3000, 3000) for _ in range(150))]
    ranges += [(900, -(2**59), 2**59), (901, None, 5), (902, 5, None), (903, 5, 5), (905, -(2**60) + 1, -5)]
    got = lookup.range_counts(spark.createDataFrame(points, "at long"), spark.createDataFrame(ranges, "range int, low long, high long"), "range", "at", "low", "high")
    want = {}
    for r, lo, hi in ranges:
        met = [p for (p,) in points if None not in (p, lo, hi) and lo <= p <= hi]
        want[r] = want.get(r, []) + met
    assert {tuple(r) for r in got.collect()} == {(r, len(met), min(met)) for r, met in want.items() if met}


def test_covers_are_short_and_disjoint(spark):
    df = spark.createDataFrame([(1, 10**12), (-7, 7), (5, 4)], "low long, high long")
    for r in df.select("*", lookup.cover(df["low"], df["high"]).alias("blocks")).collect():
        blocks = [(b["block"] << 4 * b["level"], (b["block"] + 1) << 4 * b["level"]) for b in r["blocks"] or []]
        assert sum(b - a for a, b in blocks) == max(0, r["high"] - r["low"] + 1)
        assert all(r["low"] <= a and b <= r["high"] + 1 for a, b in blocks)
        assert len(set(blocks)) == len(blocks) <= 2 * 15 * 16


def test_keywords_overlap_and_are_dealt_to_groups(spark):
    texts = spark.createDataFrame([(1, "ababab é日本"), (2, None), (3, ""), (1, "ab"), (None, "b日")], "id int, text string")
    words = spark.createDataFrame([("ab",), ("aba",), ("b",), ("日",), ("",), (None,), ("zz",), ("ab",)], "word string")
    want = {(1, "ab", 4), (1, "aba", 2), (1, "b", 4), (1, "日", 1), (None, "b", 1), (None, "日", 1)}
    for size in (10**6, 4):
        got = lookup.keyword_hits(texts, words, "id", "text", "word", size)
        assert {tuple(r) for r in got.collect()} == want
    assert lookup.keyword_hits(texts, words.limit(0), "id", "text", "word").isEmpty()
