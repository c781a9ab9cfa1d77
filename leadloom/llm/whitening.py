"""Embedding whitening: exact integer scatter, decomposed by eigh, applied to every vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Scaled entries beyond this, 2^62, count as it: the integers stay 64-bit.
LIMIT = 1 << 62
_LIMB = 20
_CELLS = 1 << 19


def usable(vector: Column) -> Column:
    """Vectors that have entries, all of them finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def shifted(rows: np.ndarray) -> np.ndarray:
    """The entries' integers with SHIFT taken off again: small numbers, whose scatter is that of the integers."""
    with np.errstate(over="ignore"):
        y = np.floor(rows * float(SCALE))
    big = np.abs(y) >= LIMIT
    out = np.where(big, 0.0, y).astype(np.int64)
    out[big] = np.where(y[big] > 0, LIMIT, -LIMIT)
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """yᵀy as Python integers.

    Doubles multiply whole numbers exactly while sums stay below 2^53, so rows of larger numbers are cut
    into limbs of 20 bits, whose products are shifted and added as integers of any size.
    """
    n, d = y.shape
    out = np.zeros((d, d), object)
    for i in range(0, n, 4096):
        part = y[i : i + 4096]
        top = int(np.abs(part).max(initial=0))
        if top * top * len(part) < 1 << 53:
            f = part.astype(np.float64)
            out += (f.T @ f).astype(np.int64).astype(object)
            continue
        limbs = []
        while part.min() < -(1 << _LIMB) or part.max() >= 1 << _LIMB:
            limbs.append((part & ((1 << _LIMB) - 1)).astype(np.float64))
            part = part >> _LIMB
        limbs.append(part.astype(np.float64))
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                out += (left.T @ right).astype(np.int64).astype(object) * (1 << _LIMB * (a + b))
    return out


def _slices(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch (id, list of doubles) with their vectors, as many rows as make few cells."""
    rows = max(1, _CELLS // d)
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Scatter:
    """Number of vectors, sums and cross-products of their shifted entries, all exact."""

    n: int
    sums: np.ndarray
    cross: np.ndarray

    @classmethod
    def none(cls, d: int) -> Scatter:
        return cls(0, np.zeros(d, object), np.zeros((d, d), object))

    def __add__(self, other: Scatter) -> Scatter:
        return Scatter(self.n + other.n, self.sums + other.sums, self.cross + other.cross)


@dataclass
class Whitening:
    """n vectors' sums (shifted), and the eigenvalues, eigenvectors (columns) and trace of their covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n times each entry's integer less the sum of its dimension, and each row's sum of squares of that, exact."""
        y = shifted(rows)
        d, top = len(self.sums), int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if top * top * d < 1 << 63:
            out = y * self.n - self.sums.astype(np.int64)
            return out, (out * out).sum(axis=1).tolist()
        out = y.astype(object) * self.n - self.sums
        return out, (out * out).sum(axis=1).tolist() if len(out) else []

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values))


def decompose(s: Scatter, components: int = COMPONENTS) -> Whitening:
    """n·YᵀY - SSᵀ as integers; only their quotients by n² are doubles, each the nearest one.

    Components without variance (eigenvalues within rounding of zero) are left out: nothing can be
    scaled by them. A component's largest entry is positive.
    """
    if not s.n:
        return Whitening(0, s.sums, np.empty(0), np.empty((len(s.sums), 0)), 0.0)
    exact = s.cross * s.n - np.outer(s.sums, s.sums)
    square = s.n * s.n
    v = np.array([[x / square for x in row] for row in exact.tolist()], np.float64)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > len(values) * np.finfo(float).eps * max(values[0], 0.0)
    values, vectors = values[keep][:components], vectors[:, keep][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(s.n, s.sums, values, vectors, sum(exact.diagonal().tolist()) / square)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows (id, vector of d doubles).

    Each task adds up its rows and sends one row of d sums and d (d + 1) / 2 products, which are added in a
    tree of tasks: what reaches the driver is bounded by the dimension.
    """
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter.none(d)
        for b in batches:
            for part, raw in _slices(b, d):
                y = shifted(raw)
                sums = y.astype(object).sum(axis=0) if np.abs(y).max(initial=0) * max(1.0, len(y)) >= 1 << 62 else y.sum(axis=0).astype(object)
                total += Scatter(part.num_rows, sums, gram(y))
        if total.n:
            texts = pa.array([[*map(str, total.sums), *map(str, total.cross[upper])]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), texts], ["n", "parts"])

    def read(r) -> Scatter:
        parts = np.array([int(x) for x in r["parts"]], object)
        cross = np.zeros((d, d), object)
        cross[upper] = parts[d:]
        cross.T[upper] = parts[d:]
        return Scatter(r["n"], parts[:d], cross)

    rdd = rows.mapInArrow(run, "n long, parts array<string>").rdd
    return decompose(rdd.treeAggregate(Scatter.none(d), lambda s, r: s + read(r), lambda a, b: a + b), components)


@dataclass
class _Spread:
    """Count, means and centred cross-products of whitened rows."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, w: np.ndarray) -> _Spread:
        mean = w.mean(axis=0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def __add__(self, other: _Spread) -> _Spread:
        if not self.n or not other.n:
            return other if other.n else self
        n, gap = self.n + other.n, other.mean - self.mean
        return _Spread(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k, d = len(w.values), len(w.sums)
    none = _Spread(0, np.zeros(k), np.zeros((k, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = none
        for b in batches:
            for _, raw in _slices(b, d):
                total += _Spread.of(w.whitened(w.centred(raw)[0]))
        if total.n:
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([total.mean.tobytes()]), pa.array([total.cross.tobytes()])], ["n", "mean", "cross"])

    def read(r) -> _Spread:
        return _Spread(r["n"], np.frombuffer(bytes(r["mean"])), np.frombuffer(bytes(r["cross"])).reshape(k, k))

    rdd = rows.mapInArrow(run, "n long, mean binary, cross binary").rdd
    got = rdd.treeAggregate(none, lambda s, r: s + read(r), lambda a, b: a + b)
    return float(np.abs(got.cross / max(1, got.n) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Vectors that are null or empty, or hold null or non-finite entries, are left out; so are those whose
    length isn't the commonest one (the longest of equally common ones). Repeated and null keys stay, each
    with its rows; extra columns are ignored. Entries beyond 2^62 / 64 count as that bound. deviation is a
    decimal, null beyond 38 digits. With one vector, or none that differ, no component has variance, and
    there are no rows; the same for an empty table. A vector's entries are doubles whatever their type.
    Three passes over the vectors: scatter, spread of the result, result; no shuffle of rows.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    rows = rows.where(F.size("vector") == d)
    w = fit(rows, d, components)
    k = len(w.values)
    error = identity_error(rows, w) if k else 0.0
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in _slices(b, d) if k else ():
                centred, squares = w.centred(raw)
                each = np.repeat(np.arange(len(raw)), k)
                sums = pa.array([Decimal(x) if x < 10**38 else None for x in squares], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(raw))),
                        pa.array(np.full(len(each), w.n)),
                        sums.take(pa.array(each)),
                        pa.array(w.whitened(centred).ravel()),
                        pa.array(np.tile(w.values / w.trace, len(raw))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names,
                )

    return rows.mapInArrow(run, schema)
