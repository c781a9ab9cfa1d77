"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import words_of

#: Every pattern of two substitutions in 13 words leaves one of these free of them at some place.
MASKS = ("11101011", "11001111")
#: Rows of benchmark seeds that are broadcast at most (about 700 bytes each); more are joined by a shuffle.
MAX_BROADCAST_SEEDS = 100_000


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, number: int, mask: str) -> Column:
    """Hash of the words that the mask selects from the one at `at`."""
    return F.xxhash64(F.lit(number), *[F.get(words, at + k) for k, c in enumerate(mask) if c == "1"])


def _seeds_at(places: str, number: int, mask: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("i"), _seed(F.col("w"), i, number, mask).alias("h")))


def _around(words: Column, at: Column, reach: int, span: int) -> Column:
    """The words from `reach` before the seed to `reach` after it; null beyond the text's ends."""
    return F.transform(F.sequence(at - reach, at + (span + reach - 1)), lambda k: F.get(words, k))


def _flags(numbers: DataFrame, size: int) -> Column:
    """array<bigint> of fixed size / 64 words whose bits are set at the numbers in column k."""
    bits = numbers.groupBy(F.expr("k div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("bits"))
    held = {r["at"]: r["bits"] for r in bits.collect()}
    return F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(size // 64))), ",").cast("array<bigint>")


def _flag(flags: Column, number: Column, size: int) -> Column:
    k = number.bitwiseAND(F.lit(size - 1))
    return F.getbit(F.get(flags, F.shiftright(k, 6).cast("int")), k.bitwiseAND(F.lit(63)).cast("int")) == 1


def _whole(words: Column) -> Column:
    """Hash of a list of words and their number."""
    return F.xxhash64(words, F.size(words))


def _run_of(n: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("i"), F.slice("w", i + 1, n).alias("doc_words"))


def _brief_pairs(rows: DataFrame, brief: DataFrame, lengths: list[int], seed_known: Callable, token_known: Callable) -> DataFrame:
    """(doc_id, item_id, x) of items shorter than the window: where all their words stand in a document."""
    found = []
    for n in lengths:
        starts = F.when(F.size("w") >= n, F.filter(F.sequence(F.lit(0), F.size("w") - n), lambda i: token_known(F.get("w", i))))
        cut = F.transform(starts, _run_of(n))
        keyed = F.transform(cut, lambda c: F.struct(c["i"].alias("i"), _whole(c["doc_words"]).alias("h"), c["doc_words"].alias("doc_words")))
        found.append(F.coalesce(F.filter(keyed, lambda c: seed_known(c["h"])), F.array()))
    hits = rows.select("doc_id", F.explode(F.concat(*found)).alias("s")).select("doc_id", "s.i", "s.h", "s.doc_words")
    small = brief.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS
    pairs = hits.join(F.broadcast(brief) if small else brief, "h").where("doc_words = item_words")
    return pairs.select("doc_id", "item_id", F.struct(F.col("n").alias("matched"), F.col("i").alias("at")).alias("x"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    window: int = 13,
    substitutions: int = 2,
    token_flags: int = 1 << 16,
    seed_flags: int = 1 << 18,
) -> DataFrame:
    """doc_id, item_id, first_word, last_word, matched: the pairs of a document and a
    benchmark item that share `window` aligned words with at most `substitutions` of them different.

    Masks name word positions that count; the others may differ. Document and item are joined on
    the hash of the counted words. Around each hit the aligned words are compared, and the best
    window that holds the seed decides. Before the join, two bit tables of fixed size, made from
    the benchmark, pass over words and seeds that no item has; they never pass over one that an
    item has. Within a document the hits stay in its row, so no text is shuffled.

    first_word and last_word are the smallest and largest start of such a window in the document,
    matched the most equal words in one. An item with fewer than `window` words is met by all of
    them, one after another and unchanged; its hash is that of all its words. Null texts and texts
    without a word match nothing, nor do texts shorter than what an item needs. Rows that repeat a doc_id or
    item_id count as one. A null doc_id or item_id is kept as a pair's null. Empty tables give no row.
    """
    span = len(masks[0])
    if any(len(m) != span for m in masks) or span > window:
        raise ValueError("masks must be of one length, the window's at most")
    reach = window - span
    items = benchmark.select("item_id", _hashes(words_of(F.col("text"))).alias("w"))
    seeds = None
    for number, mask in enumerate(masks):
        last = F.size("w") - span
        at = items.where(last >= 0).select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("p"))
        part = at.select("item_id", _seed(F.col("w"), F.col("p"), number, mask).alias("h"), _around(F.col("w"), F.col("p"), reach, span).alias("item_words"))
        seeds = part if seeds is None else seeds.union(part)
    seeds = seeds.distinct()
    brief = items.where((F.size("w") > 0) & (F.size("w") < window))
    brief = brief.select("item_id", F.size("w").alias("n"), _whole(F.col("w")).alias("h"), F.col("w").alias("item_words")).distinct()
    lengths = sorted(r["n"] for r in brief.select("n").distinct().collect())  # window - 1 at most
    words = items.select(F.explode(F.transform("w", lambda x: x.bitwiseAND(F.lit(token_flags - 1)))).alias("k"))
    token_known = _flags(words, token_flags)
    all_seeds = seeds.select("h").union(brief.select("h"))
    seed_known = _flags(all_seeds.select((F.col("h").bitwiseAND(F.lit(seed_flags - 1))).alias("k")), seed_flags)

    rows = docs.select("doc_id", _hashes(words_of(F.col("text"))).alias("w"))
    whole_rows = rows
    starts = F.when(F.size("w") >= span, F.sequence(F.lit(0), F.size("w") - span))
    known = F.filter(starts, lambda i: _flag(token_known, F.get("w", i), token_flags))
    rows = rows.select("doc_id", "w", known.alias("known"))
    found = []
    for number, mask in enumerate(masks):
        found.append(F.filter(_seeds_at("known", number, mask), lambda s: _flag(seed_known, s["h"], seed_flags)))
    near = F.transform(F.concat(*found), lambda s: F.struct(s["i"].alias("i"), s["h"].alias("h"), _around(F.col("w"), s["i"], reach, span).alias("doc_words")))
    hits = rows.select("doc_id", F.explode(near).alias("s")).select("doc_id", "s.i", "s.h", "s.doc_words")
    small = seeds.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS
    pairs = hits.join(F.broadcast(seeds) if small else seeds, "h")
    equal = F.zip_with("doc_words", "item_words", lambda x, y: F.when(x.isNull() | y.isNull(), -window).when(x == y, 1).otherwise(0))
    pairs = pairs.select("doc_id", "item_id", "i", equal.alias("equal"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("equal") - window),
        lambda s: F.struct(F.aggregate(F.slice("equal", s + 1, window), F.lit(0), lambda a, x: a + x).alias("matched"), (F.col("i") + s - reach).alias("at")),
    )
    good = F.filter(sums, lambda x: x["matched"] >= window - substitutions)
    pairs = pairs.select("doc_id", "item_id", F.explode(good).alias("x"))
    if lengths:
        pairs = pairs.union(_brief_pairs(whole_rows, brief, lengths, lambda h: _flag(seed_known, h, seed_flags), lambda w: _flag(token_known, w, token_flags)))
    return pairs.groupBy("doc_id", "item_id").agg(
        F.min("x.at").cast("long").alias("first_word"), F.max("x.at").cast("long").alias("last_word"), F.max("x.matched").cast("long").alias("matched")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that share no passage with the benchmark.

    A row is judged by its own text, whose MD5 stands for it in overlaps(): other texts under its
    doc_id, or under null, have no say.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    bad = overlaps(docs.select(digest.alias("doc_id"), "text"), benchmark, **parameters).select(F.col("doc_id").alias("_bad_digest")).distinct()
    return docs.join(bad, digest == F.col("_bad_digest"), "left_anti")


def oracle(window: int = 13, substitutions: int = 2) -> str:
    """DuckDB SQL of overlaps: all equal words of documents and items, counted along every alignment."""
    need = window - substitutions
    starts = " UNION ALL ".join(
        f"SELECT doc_id, item_id, nd, ni, d, p - {k} AS first, count(*) OVER (PARTITION BY doc_id, item_id, d ORDER BY p RANGE BETWEEN CURRENT ROW AND {window - 1 - k} FOLLOWING) AS matched FROM equal"
        for k in range(substitutions + 1)
    )
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT doc_id, {words} AS w FROM documents), items AS (SELECT item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS nd, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM docs),
iw AS (SELECT item_id, len(w) AS ni, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM items),
pairs AS (SELECT doc_id, item_id, nd, ni, p - q AS d, p FROM dw JOIN iw USING (word)),
long AS (SELECT doc_id, item_id, d FROM pairs GROUP BY ALL HAVING count(*) >= {need}),
equal AS (SELECT p.* FROM pairs p SEMI JOIN long l ON p.doc_id = l.doc_id AND p.item_id = l.item_id AND p.d = l.d),
starts AS ({starts}),
brief AS (SELECT doc_id, item_id, nd, ni, d, d AS first, count(*) AS matched FROM pairs WHERE ni < {window} GROUP BY ALL HAVING count(*) = ni),
found AS (
  SELECT doc_id, item_id, first, matched FROM starts
  WHERE matched >= {need} AND first >= 0 AND first + {window} <= nd AND first - d >= 0 AND first - d + {window} <= ni
  UNION ALL SELECT doc_id, item_id, first, matched FROM brief)
SELECT doc_id, item_id, min(first)::BIGINT AS first_word, max(first)::BIGINT AS last_word, max(matched)::BIGINT AS matched FROM found GROUP BY doc_id, item_id
"""
