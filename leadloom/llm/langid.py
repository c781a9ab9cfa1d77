"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashed, short_batches
from .toxicity import fold

#: Labelled rows that a network learns from at most, one window of each: those whose doc_id hashes lowest.
TRAIN_ROWS = 4_000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
UNKNOWN = "und"
#: For texts with a letter when nothing was learned, where a caller wants to tell them from those without.
UNLEARNED = "unlearned"
#: A letter of any script, for Spark's rlike.
LETTER = r"\p{L}"


def windows(text: str | bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased text's bytes as rows of `size`, the last padded with zeros, and each row's length."""
    raw = (text.encode() if isinstance(text, str) else text).lower()
    n = -(-len(raw) // size)
    flat = np.zeros(n * size, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    lengths = np.full(n, size)
    if n:
        lengths[-1] = len(raw) - (n - 1) * size
    return flat.reshape(n, size), lengths


@dataclass
class ByteNetwork:
    """Byte embeddings, filters of several widths, maximum over the window, softmax."""

    names: list[str]
    embedding: np.ndarray  # 256 x e
    kernels: list[np.ndarray]  # width x e x filters, for each width
    biases: np.ndarray  # widths * filters
    dense: np.ndarray  # widths * filters x languages
    offset: np.ndarray  # languages

    def tables(self) -> list[np.ndarray]:
        """What each byte adds to the filters at each distance: embedding and filters in one lookup."""
        out = []
        for j in range(max(k.shape[0] for k in self.kernels)):
            out.append(np.hstack([self.embedding @ k[j] if j < k.shape[0] else np.zeros((256, k.shape[2]), np.float32) for k in self.kernels]).astype(np.float32))
        return out

    def pooled(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The largest value of every filter in each window. Filters that would stick out at the end see zero bytes."""
        f = tables[0].shape[1]
        out = np.empty((len(x), f), np.float32)
        for i in range(0, len(x), 32):
            y = np.pad(x[i : i + 32], ((0, 0), (0, len(tables) - 1)))
            n = x.shape[1]
            acc = tables[0].take(y[:, :n], axis=0)
            for j in range(1, len(tables)):
                acc += tables[j].take(y[:, j : j + n], axis=0)
            out[i : i + 32] = acc.max(axis=1)
        return np.maximum(out + self.biases, 0)

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        z = self.pooled(x, tables) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(rows: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
    """Adam on the cross-entropy of the windows; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels], int)
    f = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "b": np.zeros(f), "d": rng.normal(0, 0.2, (f, len(names))), "o": np.zeros(len(names))}
    p |= {f"k{w}": rng.normal(0, (1 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs if len(names) > 1 else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            ids = order[i : i + batch]
            net = ByteNetwork(names, p["e"], [p[f"k{w}"] for w in WIDTHS], p["b"], p["d"], p["o"])
            x = np.pad(rows[ids], ((0, 0), (0, max(WIDTHS) - 1)))
            n, t = rows.shape[1], net.tables()
            acc = t[0][x[:, :n]]
            for j in range(1, len(t)):
                acc += t[j][x[:, j : j + n]]
            at = acc.argmax(axis=1)  # where each filter was largest: only there its gradient goes
            top = np.take_along_axis(acc, at[:, None, :], 1)[:, 0] + p["b"]
            h = np.maximum(top, 0)
            z = h @ p["d"] + p["o"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(ids)), y[ids]] -= 1
            z /= len(ids)
            g = {k: np.zeros_like(v) for k, v in p.items()}
            g["d"], g["o"] = h.T @ z, z.sum(axis=0)
            dh = (z @ p["d"].T) * (top > 0)
            g["b"] = dh.sum(axis=0)
            for c, w in enumerate(WIDTHS):
                own = slice(c * FILTERS, (c + 1) * FILTERS)
                dk, spots = dh[:, own], at[:, own]
                for j in range(w):
                    seen = np.take_along_axis(x, spots + j, 1)
                    vec = p["e"][seen]
                    g[f"k{w}"][j] += np.einsum("bfe,bf->ef", vec, dk)
                    np.add.at(g["e"], seen, dk[:, :, None] * p[f"k{w}"][j].T[None])
            step += 1
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNetwork(names, p["e"], [p[f"k{w}"] for w in WIDTHS], p["b"], p["d"], p["o"])


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> ByteNetwork | None:
    """A network of documents' lang from at most `rows` of them outside the held-out fold; None without any.

    Of each, one window's worth of characters from a place that the id's hash chooses is sent to the
    driver: the rows and their size are bounded.
    """
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("place")), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (fold(F.col("doc_id"), folds) != held_out))
    some = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.substring(F.col("text"), start, WINDOW).alias("text"))
    total = docs.where(F.col("lang").isNotNull()).count()
    got = lowest_hashed(some, "doc_id", rows, total).collect()
    got = [r for r in got if r["text"]]
    if not got:
        return None
    return fit(np.vstack([windows(r["text"])[0][:1] for r in got]), [r["lang"] for r in got])


def identify(docs: DataFrame, network: ByteNetwork | None, unlearned: str = UNKNOWN, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns with the language and its score added, as `lang_pred` and `score` or other `names`: one pass, no shuffle.

    A text's probabilities are the mean over all its windows, weighted by their lengths. Null texts
    and texts without a letter are `und` with score 0; when nothing was learned the others are
    `unlearned`, also with score 0. Columns of docs that have these names are replaced; repeated
    rows each get their result.
    """
    short_batches(docs.sparkSession)
    kept = docs.drop(*names)
    schema = kept.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema
    names_in = list(kept.columns)
    at = names_in.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else []
        for b in batches:
            found, scores = [], []
            for text, letter in zip(b.column(at), b.column(len(names_in)).to_pylist(), strict=True):
                text = text.as_py()
                if network is None or not letter:
                    found.append(unlearned if letter else UNKNOWN)
                    scores.append(0.0)
                    continue
                x, lengths = windows(text)
                p = np.average(network.probabilities(x, tables), axis=0, weights=lengths)
                k = int(p.argmax())
                found.append(network.names[k])
                scores.append(min(1.0, float(p[k])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names_in, *names])

    return kept.select("*", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter")).mapInArrow(run, schema)


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    lang_pred is a learned language, or `und` with score 0 for null and empty texts, texts without a
    letter (Unicode category L), and all texts when no label can be learned from. Rows that repeat a
    doc_id each get a row, a null doc_id stays null and counts as the empty text for its fold, texts
    of any length are read whole, other columns are ignored, an empty table gives no row.
    """
    network = train(docs, folds, held_out)
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), network)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
