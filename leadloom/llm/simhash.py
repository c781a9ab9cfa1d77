"""SimHash near-duplicates: fingerprints, deletion-variant signatures and exact components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, doc_key, key_to_id, materialize, short_batches

SEED = 42
#: Fingerprints under one signature that a task compares at once; more are linked through hubs.
BUCKET = 2048
#: Column with the number of a row while near-duplicate rows are removed.
ROW = "_row_number"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; no word: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    counts, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 65_536):
        raw = np.array(hashes[i : i + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, row: str | None = None) -> DataFrame:
    """(key, fp): each document's key and its fingerprint as a signed long; with `row` that column (a long) as row, too."""
    more = [] if row is None else [F.col(row).alias("row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["key", "fp", *b.schema.names[2:]])

    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"), *more)
    return texts.mapInArrow(run, "key long, fp long" + (", row long" if more else ""))


def _signatures(fps: DataFrame) -> DataFrame:
    """(sig, fp): 64 rows per fingerprint.

    Two halves; with three differing bits or fewer, one half differs in one bit at most, so the two
    fingerprints agree on that half with that bit deleted. A signature packs which half, which bit
    is deleted, and the 31 other bits.
    """
    half = F.explode(F.array(F.struct(F.lit(0).alias("h"), F.expr("fp & 4294967295L").alias("x")), F.struct(F.lit(1).alias("h"), F.expr("shiftrightunsigned(fp, 32)").alias("x")))).alias("half")
    wide = fps.select("fp", half).select("fp", "half.h", "half.x", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    return wide.select(F.expr("shiftleft(cast(h * 32 + j as bigint), 32) | (x & ~shiftleft(1L, j))").alias("sig"), "fp")


def _star(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each of the fingerprints to the first of its group, where any chain of near ones connects them."""
    strips = range(0, len(v), 128)
    near = np.concatenate([np.bitwise_count((v[i : i + 128, None] ^ v[None, :]).view(np.uint64)) <= most for i in strips])
    label = np.arange(len(v), dtype=np.int32)
    while True:
        new = np.concatenate([np.where(near[i : i + 128], label[None, :], np.int32(len(v))).min(axis=1) for i in strips])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(v))
    return v[far], v[label[far]]


def _compare(batches: Iterator[pa.RecordBatch], bucket: int, most: int = 3) -> Iterator[pa.RecordBatch]:
    """(crowded, a, b) from rows sorted by signature: links, or members of signatures with more than `bucket`.

    Between batches only the last signature's members are kept, `bucket` at most.
    """
    sig, fp, crowd = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in _and_end(batches):
        end = batch is None
        if not end:
            sig = np.concatenate([sig, np.asarray(batch.column(0))])
            fp = np.concatenate([fp, np.asarray(batch.column(1))])
        if not len(sig):
            continue
        links: list[tuple[np.ndarray, np.ndarray]] = []
        crowded: list[np.ndarray] = []
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(start, len(sig)))
        if crowd == sig[0]:
            crowded.append(fp[: size[0]])
            if len(start) > 1 or end:
                start, size = start[1:], size[1:]
        done = len(start) if end else max(0, len(start) - 1)
        two = start[:done][size[:done] == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= most]
        links.append((fp[near], fp[near + 1]))
        for s, n in zip(start[:done][size[:done] > 2].tolist(), size[:done][size[:done] > 2].tolist(), strict=True):
            if n > bucket:
                crowded.append(fp[s : s + n])
            else:
                links.append(_star(fp[s : s + n], most))
        if not end:
            last = start[-1]
            if crowd == sig[-1] and len(start) == 1:
                sig, fp = sig[:0], fp[:0]
            elif size[-1] > bucket:
                crowd = sig[-1]
                crowded.append(fp[last:])
                sig, fp = sig[:0], fp[:0]
            else:
                sig, fp = sig[last:], fp[last:]
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        c = np.concatenate(crowded) if crowded else fp[:0]
        flags = np.repeat([False, True], [len(a), len(c)])
        yield pa.RecordBatch.from_arrays([pa.array(flags), pa.array(np.append(a, c)), pa.array(np.append(b, c))], ["crowded", "a", "b"])


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _hubs(fps: DataFrame) -> DataFrame:
    """Links among fingerprints through hubs, 4,096 rows each, without comparing pairs.

    A hub is a pattern with one deleted bit. Fingerprints within one differing bit of a hub differ
    in three bits at most, and any two that do have such a hub in common.
    """
    wild = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select("fp", "j", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    # k = j changes nothing, as that bit is deleted: the pattern itself.
    hub = wild.select("fp", "j", F.expr("(fp ^ shiftleft(1L, k)) & ~shiftleft(1L, j)").alias("x"))
    least = hub.groupBy("j", "x").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    return hub.join(least, ["j", "x"]).where("fp != a").select("a", F.col("fp").alias("b"))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints with three differing bits or fewer.

    Not all pairs, but enough that components are those of all pairs. Signatures are dealt out and
    sorted once. Up to `bucket` members of one are compared where they meet and give one link per
    member; members of still larger ones are linked through hubs.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_sigs = _signatures(fps.repartition(tasks)).repartition(tasks, "sig").sortWithinPartitions("sig", "fp")
    found = materialize(sorted_sigs.mapInArrow(lambda it: _compare(it, bucket), "crowded boolean, a long, b long").distinct())
    crowded = found.where("crowded").select(F.col("a").alias("fp"))
    return found.where("not crowded").select("a", "b").union(_hubs(crowded)).distinct()


def _components(table: DataFrame, least: Column, bucket: int) -> DataFrame:
    """(fp, component): for each fingerprint of the table the smallest `least` of its component."""
    nodes = materialize(table.groupBy("fp").agg(least.alias("least")))
    roots = connected_components(materialize(links(nodes.select("fp"), bucket)))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    return joined.join(smallest, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable over links of
    three differing bits or fewer. Documents with equal fingerprints are one node, so copies are
    never paired. Null and empty texts have fingerprint zero and are linked like any other; a null
    doc_id sorts first, and its component's id is then null; rows that repeat a doc_id each get a
    row; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    table = materialize(fingerprints(docs, shingle))
    return table.join(_components(table, F.min("key"), bucket), "fp").select(
        key_to_id(F.col("key")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        key_to_id(F.col("component")).alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each component of near_duplicates(): the one with the least doc_id, null first, then row number.

    Rows are numbered once, in a table in the shared folder, and go by that number alone: rows that
    repeat a doc_id, share one with another text or have none are judged like all others.
    """
    short_batches(docs.sparkSession)
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "zstd")
    table = materialize(fingerprints(rows, shingle, ROW))
    component = _components(table, F.min(F.struct("key", "row")), bucket)
    extra = table.join(component, "fp").where(F.col("row") != F.col("component.row")).select(F.col("row").alias(ROW))
    return rows.join(extra, ROW, "left_anti").select(*docs.columns)
