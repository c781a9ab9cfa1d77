"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, connected_components, key_to_id, materialize

#: Width of the cells of a projection, and the share of pairs at the threshold that is to be found.
WIDTH = 0.8
RECALL = 0.98
#: Vectors that are nowhere near and still share a bucket with a vector, over all tables, about.
STRANGERS = 8
#: Members of a bucket that are compared in one piece; larger buckets are cut and every two pieces meet.
PIECE = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, normalised, in double precision."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _meet(distance: float, width: float) -> float:
    """Probability that two vectors at a distance fall into one cell of a random projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(tables, projections) for so many rows.

    Projections grow with the logarithm of the rows, so that a vector meets about as many vectors at
    right angles to it however many there are; tables grow with a small power of the rows, so that a
    pair at the threshold is met with probability `recall`.
    """
    near, far = _meet(math.sqrt(2 - 2 * threshold), width), _meet(math.sqrt(2), width)
    projections = tables = 1
    while True:
        tables = math.ceil(math.log(1 - recall) / math.log(1 - near**projections))
        if rows * tables * far**projections <= STRANGERS:
            return tables, projections
        projections += 1


@lru_cache(maxsize=8)
def _projections(n: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, n])
    return rng.normal(size=(n, tables * projections)), rng.uniform(0, width, tables * projections)


def signatures(x: np.ndarray, tables: int, projections: int, width: float, seed: int = 3) -> np.ndarray:
    """For each normalised row and table: a hash of its quantised random projections."""
    a, b = _projections(x.shape[1], tables, projections, width, seed)
    cells = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, projections)
    h = np.zeros((len(x), tables), np.uint64)
    for k in range(projections):
        h = (h ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and normalised vectors of each vector length in the batch."""
    lengths = np.asarray(pc.list_value_length(column))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _matrix(column.take(pa.array(at)))


def _vector(vectors: DataFrame, vector_col: str) -> Column:
    """The vectors as they are if they are of single precision, else in double precision."""
    kind = dict(vectors.dtypes)[vector_col]
    return F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """One row per distinct label and usable vector, numbered: c, label, v, least id, number of rows m."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    ok = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    rows = ok.select(F.col(label_col).alias("label"), _vector(vectors, vector_col).alias("v"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    groups = rows.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    return groups.withColumn("c", F.monotonically_increasing_id())


def _compare(ids, x, m, sigs, ids2, x2, m2, sigs2, table: int, threshold: float, same: bool):
    """Links between two pieces: (ids, links first met in this table) and star edges of the pieces' components."""
    near = (x @ x2.T) >= threshold
    if same:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    first = (sigs[i] == sigs2[j]).argmax(axis=1) == table  # counted where both first share a bucket
    out_ids = [ids]
    counts = [np.bincount(i[first], weights=m2[j[first]], minlength=len(ids))]
    if not same:
        out_ids.append(ids2)
        counts.append(np.bincount(j[first], weights=m[i[first]], minlength=len(ids2)))
        j = j + len(ids)
    everyone = np.concatenate(out_ids)
    root = np.arange(len(everyone))
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return everyone, np.concatenate(counts).astype(np.int64), everyone[root]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int | None = None,
    projections: int | None = None,
    width: float = WIDTH,
    piece: int = PIECE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors of one label and length are put in a bucket of each table by their quantised random
    projections; those that share a bucket are compared by cosine in double precision. A pair at
    the threshold is found with probability 0.98 at the default parameters, closer ones almost
    surely. Equal vectors are one class with a multiplicity, never paired. Buckets of more than
    `piece` classes are cut into pieces; every two pieces are compared in a task of their own, so a
    task holds 2 x piece vectors at most, and gives a count and one link per class, not pairs.

    A pair that shares several buckets is counted in the first. Null, zero or non-finite vectors,
    null components and null labels link with nothing. A null vec_id sorts first and stays null.
    Each of several rows with one vec_id is a vector of its own. Other columns are ignored; an empty
    table gives no row.
    """
    classes = materialize(_classes(vectors, id_col, vector_col, label_col))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column(1)):
                s = signatures(x, tables, projections, width)
                rows = np.repeat(at, tables)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), b.column(2).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1])), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(s.ravel())],
                    ["c", "label", "size", "t", "bucket"],
                )

    kind = dict(classes.dtypes)["label"]
    n = classes.count()
    if not n:
        return _nothing(vectors, id_col)
    planned = plan(n, threshold, width)
    tables, projections = tables or planned[0], projections or planned[1]
    signed = classes.select("c", "v", "label").mapInArrow(sign, f"c long, label {kind}, size long, t int, bucket long")
    keyed = signed.select("c", "t", F.xxhash64("label", "size", "t", "bucket").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(full, "key").withColumn("pieces", F.ceil(F.col("n") / piece).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int"))
    met = members.select("c", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    met = met.select("c", "t", "key", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    rows = met.join(classes.select("c", "v", "m", "label"), "c").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (alike for group in _groups(batches) for alike in _alike(group)):
            ids, t, own, p, q = (np.asarray(group.column(k).combine_chunks()) for k in ("c", "t", "own", "p", "q"))
            x, m = _matrix(group.column("v").combine_chunks()), np.asarray(group.column("m").combine_chunks()).astype(float)
            s = signatures(x, tables, projections, width)
            a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
            same = p[0] == q[0]
            got = _compare(ids[a], x[a], m[a], s[a], ids[b], x[b], m[b], s[b], int(t[0]), threshold, same)
            yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["c", "links", "root"])

    found = materialize(rows.select("key", "p", "q", "c", "t", "own", "v", "m", "label").mapInArrow(compare, "c long, links long, root long").where("links > 0 or c != root"))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("c != root").select("c", "root").distinct(), "c", "root")
    of = classes.join(counts, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    of = of.select("label", "v", "least", F.coalesce("root", "c").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    of = of.join(least, "root").select("label", "v", "n_links", "component")
    each = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label_col).alias("label"), _vector(vectors, vector_col).alias("v"))
    out = each.join(of, ["label", "v"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return _named(out, id_col)


def _named(out: DataFrame, id_col: str) -> DataFrame:
    return out.select(key_to_id(F.col("id")).alias(id_col), "n_links", key_to_id(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _nothing(vectors: DataFrame, id_col: str) -> DataFrame:
    """No usable vector: every row stands alone."""
    each = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    return _named(each.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")), id_col)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal key, p and q in the sorted rows, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[:, s])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _alike(group: pa.Table) -> Iterator[pa.Table]:
    """The group by label and length: buckets are keyed by a hash, which different ones may share."""
    labels = group.column("label").combine_chunks().dictionary_encode()
    kinds = np.stack([np.asarray(labels.indices), np.asarray(pc.list_value_length(group.column("v").combine_chunks()))])
    if (kinds == kinds[:, :1]).all():
        yield group
        return
    of = np.unique(kinds, axis=1, return_inverse=True)[1].ravel()
    for k in range(of.max() + 1):
        yield group.take(np.flatnonzero(of == k))


def oracle(threshold: float = 0.98) -> str:
    """DuckDB SQL of near_duplicates on embeddings: all pairs of a label, and components by reachability."""
    return f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {threshold}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(least(a, b)) AS root FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id)::BIGINT AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
