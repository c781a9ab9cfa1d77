"""Exact removal of repeated substrings over a whole corpus, by shards of suffix arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_key, key_to_id, materialize, short_batches
from .suffixes import common_prefixes, suffix_array

#: Repeats of this many bytes are removed.
LENGTH = 100
#: Bytes of the strings whose hashes cut texts into cells.
GRAM = 16
#: Bytes of text that a task looks at together, and bytes in a shard of suffix arrays, about.
BUFFER = 1 << 19
SHARD_BYTES = 1 << 19
#: Cells of one anchor with more bytes than this are dealt to several shards first.
HOT_BYTES = 4_000_000
#: Times that what is left of such cells is cut anew before its windows are dealt one by one.
RECUTS = 3
#: Contents that a task remembers at most, to tell repeats of them before they are sent.
SEEN = 50_000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    h = words[:n] * _C1
    h ^= (h >> np.uint64(32)) ^ np.uint64(seed * 0x9FB21C651E98DF25 % (1 << 64))
    h += words[8 : 8 + n] * _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    """Powers of an odd number and of its inverse, kept for the next texts."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.power = self.back = np.ones(1, np.uint64)

    def stretches(self, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A hash of each stretch of h, from s to e."""
        if len(self.power) < len(h) + 1:
            self.power = np.cumprod(np.append(np.uint64(1), np.full(len(h), self.base)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(len(h), self.inverse)))
        sums = np.append(np.uint64(0), np.cumsum(h * self.power[: len(h)]))
        return (sums[e] - sums[s]) * self.back[s]


_FIRST, _SECOND = _Powers(_C1), _Powers(_C2)


def cells(keys: np.ndarray, ids: np.ndarray, texts: list[bytes], length: int = LENGTH, seed: int = 0) -> dict[str, np.ndarray]:
    """anchor, content, check, n, key, text_id, s, twice: the cells of all texts.

    The anchor of a window of `length` bytes is the least hash of the strings in it. A cell is a run
    of n window starts, from s on, with one anchor. Equal windows have equal anchors, so they are in
    cells of one anchor; content (64 bits) and check (32 bits) are independent hashes of all the bytes that the cell's
    windows cover. twice tells that the anchor stands in the cell more than once: else no two of its windows are equal.
    """
    wide = length - GRAM + 1
    empty = np.empty(0, np.int64)
    keep = [i for i, t in enumerate(texts) if len(t) >= length]
    if not keep:
        return {k: empty for k in ("anchor", "content", "check", "n", "key", "text_id", "s", "twice")}
    raw = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
    sizes = np.array([len(texts[i]) for i in keep])
    offset = np.cumsum(sizes) - sizes
    h = _gram_hashes(raw, seed)
    low, reach = h, 1
    while reach * 2 <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    windows = sizes - length + 1
    doc = np.repeat(np.arange(len(keep)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - offset, windows)
    low = low[at]
    first = np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(at)))
    s = at[start]
    content = _FIRST.stretches(h, s, s + n + wide - 1)
    check = _SECOND.stretches((h ^ (h >> np.uint64(31))) * _C3, s, s + n + wide - 1)
    size = n + wide - 1
    begin = np.cumsum(size) - size
    hit = h[np.arange(size.sum()) + np.repeat(s - begin, size)] == np.repeat(low[start], size)
    twice = (np.add.reduceat(hit, begin, dtype=np.int64) > 1).astype(np.int64)
    key, text_id = (np.asarray(x)[keep][doc[start]] for x in (keys, ids))
    return {"anchor": low[start].view(np.int64), "content": content.view(np.int64), "check": check.view(np.int64) >> 32, "n": n, "key": key, "text_id": text_id, "s": s - offset[doc[start]], "twice": twice}


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    keys, ids, texts, size = [], [], [], 0
    for b in batches:
        for key, text_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            keys.append(key)
            ids.append(text_id)
            texts.append(b"" if text.as_py() is None else text.as_py())
            size += len(texts[-1])
            if size >= BUFFER:
                yield keys, ids, texts
                keys, ids, texts, size = [], [], [], 0
    if keys:
        yield keys, ids, texts


CELLS = "anchor long, content long, check int, n long, key long, text_id long, s long, twice long"
#: kind 0: a cell that repeats one with the same content; kind 1: the first of its content, to be sorted.
FOUND = "kind int, anchor long, n long, key long, text_id long, s long"
#: One document: rows with both equal are the same text under the same doc_id. Also the order in which a text counts as earlier.
DOC = ["key", "text_id"]


class _Seen:
    """The earliest places of contents that a task has met more than once, SEEN at most."""

    def __init__(self, most: int = SEEN):
        self.most = most
        self.rows = np.empty((0, 8), np.int64)  # mixed hash, then anchor, content, check, n, key, text_id, s

    def again(self, c: dict[str, np.ndarray]) -> np.ndarray:
        """True for cells that have an equal one at an earlier place among these or those seen before."""
        own = np.stack([c[k] for k in ("anchor", "content", "check", "n", "key", "text_id", "s")], axis=1)
        mixed = (c["content"].view(np.uint64) ^ (c["check"].view(np.uint64) * _C2)).view(np.int64)
        rows = np.concatenate([self.rows, np.column_stack([mixed, own])])
        _, group, size = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        at = np.flatnonzero(size[group] > 1)  # all else is the first of its content
        some = rows[at]
        order = np.lexsort((some[:, 7], some[:, 6], some[:, 5], some[:, 0]))
        some, at = some[order], at[order]
        head = np.maximum.accumulate(np.where(np.append(True, some[1:, 0] != some[:-1, 0]), np.arange(len(some)), 0)) if len(some) else order
        least = some[head]
        flag = np.zeros(len(rows), bool)
        flag[at] = (some[:, :5] == least[:, :5]).all(axis=1) & (some[:, 5:] != least[:, 5:]).any(axis=1)
        self.rows = some[np.unique(head)][-self.most :] if len(some) else rows[:0]
        return flag[len(rows) - len(own) :]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of the cells, from rows sorted by anchor, content, check, n, key, text_id and s.

    Only the last row and, for its anchor, the one first cell that may turn out alone are kept
    between batches. Cells known to be repeats (twice has bit 1) pass through.
    """
    names = ["kind", "anchor", "n", "key", "text_id", "s"]
    last: tuple[int, ...] | None = None
    waiting: np.ndarray | None = None  # the only first cell so far of the last row's anchor
    for b in batches:
        table = np.stack([np.asarray(c).astype(np.int64) for c in b.columns])
        known = (table[7] & 2) > 0
        if known.any():
            a, n, key, text_id, s = table[[0, 3, 4, 5, 6]][:, known]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), *map(pa.array, (a, n, key, text_id, s))], names)
            table = table[:, ~known]
        if not table.shape[1]:
            continue
        a, n, key, text_id, s, twice = table[[0, 3, 4, 5, 6, 7]]
        new = np.append(True, (table[:4, 1:] != table[:4, :-1]).any(axis=0))
        group = np.append(True, a[1:] != a[:-1])
        same = np.append(False, ~new[1:] & (table[4:7, 1:] == table[4:7, :-1]).all(axis=0))  # a repeated row
        if last is not None:
            group[0] = a[0] != last[0]
            new[0] = tuple(table[:4, 0]) != last[:4]
            same[0] = tuple(table[:7, 0]) == last
        number = np.cumsum(group) - (0 if not group[0] else 1)  # a group that goes on from the last batch is 0
        size = np.bincount(number, weights=new, minlength=number[-1] + 1).astype(int)
        rows = np.stack([a, n, key, text_id, s, twice], axis=1)
        alone = np.zeros(len(a), bool)
        out = []
        if not group[0]:
            if waiting is not None and size[0]:
                out.append(waiting)
                waiting = None
            alone[number == 0] = waiting is not None  # then it has no new one here
        elif waiting is not None:
            if waiting[5]:
                out.append(waiting)
            waiting = None
        begun = number >= (0 if group[0] else 1)
        alone |= begun & (size[number] == 1)
        final = number == number[-1]
        if (final & new & alone).any():
            waiting = rows[np.flatnonzero(final & new & alone)[0]]
        take = new & (~alone | ((twice > 0) & ~final))
        again = rows[~new & ~same]
        sort = np.concatenate([rows[take], *[o[None] for o in out]])
        last = tuple(table[:7, -1])
        both = np.concatenate([again, sort])
        kind = np.repeat(np.array([0, 1], np.int32), [len(again), len(sort)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(both[:, k]) for k in range(5))], names)
    if waiting is not None and waiting[5]:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([1], np.int32)), *(pa.array(waiting[k : k + 1]) for k in range(5))], names)


def repeats_in(rows: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """For each row with any, the starts of windows that occur in an earlier row or earlier in it.

    The rows' suffixes are sorted, neighbours with `length` bytes in common are one group, and all of
    a group but its first position are repeats.
    """
    sizes = np.array([len(r) for r in rows])
    raw = np.frombuffer(b"\0".join(rows) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    row = np.repeat(np.arange(len(rows)), sizes + 1)
    room = ends[row] - np.arange(len(raw))
    symbols = raw.astype(np.int64) + 1
    symbols[ends] = 0
    order = suffix_array(symbols)
    common = common_prefixes(raw, order, room)[order]
    first = common < length
    first[0] = True
    group = np.cumsum(first) - 1
    least = np.minimum.reduceat(order, np.flatnonzero(first))
    again = order[(least[group] != order) & (room[order] >= length)]
    again.sort()
    of = row[again]
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        if y > x:
            yield int(of[x]), again[x:y] - begins[of[x]]


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the bytes covered by windows at sorted starts, merged where they touch."""
    cut = np.flatnonzero(starts[1:] - starts[:-1] > length) + 1
    return starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + length


def _sort(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of a shard's rows that also start earlier in it."""
    pdf = pdf.drop_duplicates([*DOC, "s"]).sort_values([*DOC, "s"])
    keys, ids, at = (pdf[c].to_numpy() for c in (*DOC, "s"))
    out = []
    for k, starts in repeats_in(list(pdf["raw"]), length):
        begin, end = _runs(starts, length)
        out.append((np.full(len(begin), keys[k]), np.full(len(begin), ids[k]), begin + at[k], end + at[k]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
    return pd.DataFrame(dict(zip((*DOC, "begin", "end"), cols, strict=True)))


def _sort_part(pdf: pd.DataFrame, length: int, recut: int) -> pd.DataFrame:
    """Of a part of a hot anchor's rows: the spans that repeat in the part, and what else there is, cut anew.

    What is left may repeat windows of other parts. It is cut into cells by other hashes, or, when
    recut is above RECUTS, into single windows; their anchors take the old one in.
    """
    pdf = pdf.drop_duplicates([*DOC, "s"]).sort_values([*DOC, "s"])
    old, keys, ids, at = (pdf[c].to_numpy() for c in ("anchor", *DOC, "s"))
    raws = list(pdf["raw"])
    repeats = dict(repeats_in(raws, length))
    spans, left, of, start = [], [], [], []
    for k, raw in enumerate(raws):
        again = repeats.get(k)
        fresh = np.ones(len(raw) - length + 1, bool)
        if again is not None:
            fresh[again] = False
            begin, end = _runs(again, length)
            spans.append((np.full(len(begin), k), begin, end))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], fresh, [0]]))).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            left.append(raw[a : b + length - 1])
            of.append(k)
            start.append(a)
    frames = []
    if spans:
        k, begin, end = (np.concatenate(c) for c in zip(*spans, strict=True))
        frames.append(pd.DataFrame({"anchor": old[k], "key": keys[k], "text_id": ids[k], "s": begin + at[k], "end": end + at[k], "raw": None}))
    if left:
        of, start, number = np.array(of), np.array(start), np.arange(len(left))
        if recut <= RECUTS:
            c = cells(number, number, left, length, recut)
            piece, s, n, anchor = c["key"], c["s"], c["n"], c["anchor"]
        else:
            counts = np.array([len(x) - length + 1 for x in left])
            piece = np.repeat(number, counts)
            s = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
            n = np.ones(len(piece), np.int64)
            h = [_gram_hashes(np.frombuffer(x, np.uint8), recut) for x in left]
            anchor = np.concatenate([_FIRST.stretches(x, np.arange(m), np.arange(m) + length - GRAM + 1) for x, m in zip(h, counts.tolist(), strict=True)]).view(np.int64)
        k = of[piece]
        anchor = (old[k].view(np.uint64) * _C1 ^ anchor.view(np.uint64)).view(np.int64)
        raw = [left[i][a : a + m + length - 1] for i, a, m in zip(piece.tolist(), s.tolist(), n.tolist(), strict=True)]
        frames.append(pd.DataFrame({"anchor": anchor, "key": keys[k], "text_id": ids[k], "s": s + start[piece] + at[k], "end": -1, "raw": raw}))
    return pd.concat(frames) if frames else pd.DataFrame({c: [] for c in ("anchor", "key", "text_id", "s", "end", "raw")})


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(key, text_id, begin, end): stretches of bytes covered by `length`-byte strings that also start earlier.

    docs has key and text_id (longs) and raw (bytes): rows that agree in key and text_id have the same
    raw and are one document, and documents follow each other in that order. Spans of one may overlap.
    Lists hold cells or spans of one document, so none outgrows a text.

    Texts are cut into cells (see cells()); each cell's hashes and place, not its text, are sorted by
    anchor. Cells with the same content as an earlier one are repeats as a whole; content is
    identified by its length and 160 bits of three hashes (anchor, content and check). A task tells
    most repeats of frequent cells itself and deals them out evenly. The first of each content is
    sorted with those of the same anchor: their bytes are sent to a shard by the anchor, and a suffix
    array of the shard finds which of their windows occur earlier. As equal windows have equal
    anchors, no match crosses shards. Anchors that only one content has are not sorted, as they
    repeat nothing, unless the anchor stands in the cell twice, so that it may repeat itself.

    Cells of an anchor with more than `hot_bytes` to sort are dealt to parts of about `shard_bytes`.
    The suffix array of a part finds the repeats within it; what is left is cut into cells anew, by
    other hashes, and sorted by the same rule until no anchor is hot: windows that all parts share
    are one per part by then, and the others have been dealt to different anchors.
    """
    texts = docs.select(*DOC, "raw")
    sorted_cells = texts.mapInArrow(_cut_for(length), CELLS).repartition("anchor").sortWithinPartitions("anchor", "content", "check", "n", *DOC, "s")
    found = materialize(sorted_cells.mapInArrow(_firsts, FOUND), "zstd")
    spent = [found]
    spans = found.where("kind = 0").select(*DOC, F.col("s").alias("begin"), (F.col("s") + F.col("n") + length - 1).alias("end"))

    first = found.where("kind = 1")
    weights = materialize(_hot(first.groupBy("anchor").agg(F.sum(F.col("n") + length - 1).alias("bytes")), hot_bytes, shard_bytes))
    total = first.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0
    if not total:
        return spans
    hot = not weights.isEmpty()
    wanted = first.join(weights, "anchor", "left") if hot else first.withColumn("parts", F.lit(None).cast("int"))
    lists = wanted.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("s", "n", "anchor", F.coalesce("parts", F.lit(0)).alias("parts")))).alias("cells"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for i in range(b.num_rows):
                doc = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if doc == last:  # a repeated row: the merge join brings them one after the other
                    continue
                last = doc
                raw = b.column(2)[i].as_py() or b""
                s, n, anchor, parts = (np.asarray(b.column(3)[i].values.field(k).to_numpy(zero_copy_only=False)) for k in range(4))
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "parts": parts, "key": np.full(len(s), doc[0]), "text_id": np.full(len(s), doc[1]), "s": s, "raw": pa.array([raw[x : x + y + length - 1] for x, y in zip(s.tolist(), n.tolist(), strict=True)], pa.binary())})

    pieces = texts.join(lists.hint("merge"), DOC).select(*DOC, "raw", "cells").mapInArrow(fetch, "anchor long, parts int, key long, text_id long, s long, raw binary")
    if hot:
        pieces = materialize(pieces)
        spent.append(pieces)
    recut = 0
    while True:
        shards = max(1, math.ceil(total / shard_bytes))
        shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
        cold = pieces.where("parts = 0").select(shard, *DOC, "s", "raw").groupBy("shard")
        spans = spans.union(cold.applyInPandas(lambda pdf: _sort(pdf, length), "key long, text_id long, begin long, end long"))
        if not hot:
            out = materialize(spans)
            for table in spent:
                discard(table)
            return out
        recut += 1
        salt = F.pmod(F.xxhash64(*DOC, "s"), "parts").alias("salt")
        dealt = pieces.where("parts > 0").select("anchor", salt, *DOC, "s", "raw").groupBy("anchor", "salt")
        done = materialize(dealt.applyInPandas(_part_sorter(length, recut), "anchor long, key long, text_id long, s long, end long, raw binary"))
        spent.append(done)
        spans = spans.union(done.where("end >= 0").select(*DOC, F.col("s").alias("begin"), "end"))
        left = done.where("end < 0").drop("end")
        size = F.octet_length("raw").cast("long")
        weights = materialize(_hot(left.groupBy("anchor").agg(F.sum(size).alias("bytes")), hot_bytes, shard_bytes))
        total = left.agg(F.sum(size)).first()[0] or 0
        hot = not weights.isEmpty()
        pieces = left.join(weights, "anchor", "left") if hot else left.withColumn("parts", F.lit(None).cast("int"))
        pieces = pieces.select("anchor", F.coalesce("parts", F.lit(0)).alias("parts"), *DOC, "s", "raw")


def _part_sorter(length: int, recut: int):
    return lambda pdf: _sort_part(pdf, length, recut)


def _hot(weights: DataFrame, hot_bytes: int, shard_bytes: int) -> DataFrame:
    """(anchor, parts): the anchors above `hot_bytes`, and the number of parts their cells are dealt to."""
    return weights.where(F.col("bytes") > hot_bytes).select("anchor", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts"))


def _cut_for(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for keys, ids, texts in _buffers(batches):
            c = cells(np.array(keys, np.int64), np.array(ids, np.int64), texts, length)
            again = seen.again(c)
            spread = (c["text_id"].view(np.uint64) ^ (c["s"].view(np.uint64) * _C1)) * _C3
            c["anchor"] = np.where(again, spread.view(np.int64), c["anchor"])
            c["twice"] = c["twice"] | (2 * again)
            c["content"] = np.where(again, 0, c["content"])
            c["check"] = np.where(again, 0, c["check"]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(c)

    return cut


def merge(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of stretches, within a text of `size` bytes."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(np.minimum(end[order], size))
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    begin, end = begin[np.append(0, cut)], end[np.append(cut - 1, len(end) - 1)]
    return begin[begin < end], end[begin < end]


def _kept(raw: bytes, spans) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    if spans is None:
        return raw, 0
    begin, end = merge(*(np.asarray(spans.values.field(k).to_numpy(zero_copy_only=False)) for k in range(2)), len(raw))
    left = [raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True)]
    return b"".join(left), len(begin)


def remove_repeats(docs: DataFrame, length: int = LENGTH, names: tuple[str, str] = ("kept", "n_spans"), **parameters) -> DataFrame:
    """docs with the remaining bytes and the number of maximal removed runs added, as `kept` and `n_spans` or other `names`.

    Every byte covered by a `length`-byte string that also starts earlier, in a document with a
    smaller doc_id or further ahead in the same one, is removed; matches never cross documents and
    are judged on the input. Null and short texts keep all they have; a null doc_id comes before all
    others. Rows that repeat a doc_id (or null) with the same text are one document and share its
    result; with another text they are documents of their own, in the order of their texts' hashes.
    Columns of docs that have these names are replaced; an empty table gives no row.
    """
    short_batches(docs.sparkSession)
    kept = docs.drop(*names)
    columns = list(kept.columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = repeated_spans(docs.select(doc_key().alias("key"), F.xxhash64(text).alias("text_id"), F.encode(text, "UTF-8").alias("raw")), length, **parameters)
    lists = spans.groupBy(F.col("key").alias("span_key"), F.col("text_id").alias("span_text")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = kept.join(lists, (doc_key() == F.col("span_key")) & (F.xxhash64(text) == F.col("span_text")), "left").drop("span_key", "span_text")
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_kept((t.as_py() or "").encode(), s if s.is_valid else None) for t, s in zip(b.column(at), b.column(len(columns)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64())], [*columns, *names])

    schema = kept.select("*", F.lit(b"").alias(names[0]), F.lit(0).cast("long").alias(names[1])).schema
    return joined.mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """docs with text replaced by what remove_repeats() keeps of it; bytes of cut characters are left out too."""
    done = remove_repeats(docs, length, ("_kept_bytes", "_removed_runs"), **parameters)
    names = list(docs.columns)
    at, kept = names.index("text"), done.columns.index("_kept_bytes")
    order = [done.columns.index(c) for c in names]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k) for k in order]
            old, new = columns[at], b.column(kept)
            columns[at] = pa.array([x.as_py().decode("utf-8", "ignore") if o.is_valid else None for o, x in zip(old, new, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return done.mapInArrow(decode, docs.schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeats()."""
    done = remove_repeats(docs.select(key_to_id(doc_key()).alias("doc_id"), "text"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL of repeat_digests: every window is looked up among all earlier ones."""
    block = 1000
    return f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT doc_id, s, least({block}, n - {length - 1} - s) AS m, substr(h, (2 * s + 1)::BIGINT, {2 * (block + length - 1)}) AS part
  FROM (SELECT *, unnest(range(0, n - {length - 1}, {block})) AS s FROM docs)),
windows AS (SELECT doc_id, s + i AS s, md5_number(substr(part, (2 * i + 1)::BIGINT, {2 * length})) AS k FROM (SELECT *, unnest(range(m)) AS i FROM blocks)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
cuts AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > {length}, TRUE)::INT AS cut FROM again),
runs AS (SELECT doc_id, min(s) AS b, max(s) + {length} AS e FROM (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM cuts) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, b FROM runs
  UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(b, n) - a))::BIGINT), '' ORDER BY a) AS left_hex, count(*) - 1 AS spans
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, (n - coalesce(length(left_hex), 2 * n) // 2)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def brute_force(docs: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same figures from a set of all windows: for small tables, to test against."""
    seen: set[bytes] = set()
    out = {}
    for key, raw in sorted(docs):
        covered = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                covered[s : s + length] = True
            seen.add(w)
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[0])
        left = np.frombuffer(raw, np.uint8)[~covered[:-1]].tobytes()
        out[key] = (len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out
