"""Language-model scores: context-tree weighting over bytes, beside a unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, short_methods
from .toxicity import fold

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 24_000_000
#: Contexts are this many bytes at most.
DEPTH = 5
#: Characters of texts, or bytes of one, that are scored at once.
BATCH = 1 << 16
#: Rows of one id and text are counted once, with their number, beyond so many.
HOT = 1_000
END = b"\n"
#: Marks keys of byte strings; keys of tokens have this bit clear.
_GRAM = 1 << 62


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space of the ASCII-lower-cased text, and one end."""
    return [*(text or "").encode().lower().split(), END]


def _keys(batch: list[list[bytes]]) -> np.ndarray:
    """The key of every token of a batch of texts, one after the other."""
    found = [np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64) for words in batch]
    return (np.concatenate(found) & np.uint64(_GRAM - 1)).astype(np.int64)


def _batches(texts: Iterable[str | None], size: int) -> Iterator[list[list[bytes]]]:
    """The tokens of texts, in batches that end with the text that brings them to `size` characters."""
    batch, length = [], 0
    for text in texts:
        batch.append(tokens(text))
        length += len(text or "")
        if length >= size:
            yield batch
            batch, length = [], 0
    if batch:
        yield batch


def _bytes(words: list[bytes]) -> bytes:
    """What the model reads of a text: an empty context, then its words and the end."""
    return b"\0" * DEPTH + b" ".join(words[:-1]) + END


def _grams(raw: np.ndarray) -> np.ndarray:
    """Each byte with the DEPTH bytes before it, as one number."""
    x = raw.astype(np.int64)
    g = x[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        g |= x[DEPTH - k : len(x) - k] << 8 * k
    return g


def _collect(parts: list[bytes]) -> np.ndarray:
    """The byte strings of all parts, one part after the other; none reaches from one part into the next."""
    if not parts:
        return np.empty(0, np.int64)
    starts = np.cumsum([len(p) for p in parts[:-1]], dtype=np.int64)
    return np.delete(_grams(np.frombuffer(b"".join(parts), np.uint8)), (starts[:, None] - DEPTH + np.arange(DEPTH)).ravel())


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def _count_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """chunk, key, n: every token and byte string of the chunk's texts, n times in those to learn from."""
    train, once = pdf["train"], pdf["copies"] == 1
    groups = [(1, pdf.loc[train & once, "text"]), (0, pdf.loc[~train, "text"])]
    groups += [(copies, [text]) for text, copies in pdf.loc[train & ~once, ["text", "copies"]].itertuples(index=False)]
    keys, counts = [], []
    for copies, texts in groups:
        for batch in _batches(texts, 500_000):
            strings = _collect([_bytes(words) for words in batch]) | _GRAM
            found, n = np.unique(np.concatenate([_keys(batch), strings]), return_counts=True)
            keys.append(found)
            counts.append(n * copies)
            if len(keys) > 8:
                keys, counts = ([x] for x in _merged(keys, counts))
    key, n = _merged(keys, counts)
    return pd.DataFrame({"chunk": np.full(len(key), pdf["chunk"].iat[0]), "key": key, "n": n})


def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of x >= 0.5: Stirling's series seven steps further up."""
    y = x + 7
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _estimate(a: Column, b: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def context_tree(grams: DataFrame) -> list[DataFrame]:
    """Tables (ctx, node, a, b, w) for contexts of 0 to DEPTH bytes, from (gram, n).

    Each byte is eight binary decisions along the nodes 1 to 255 of a tree; every node has a context
    tree of its own, in which a context's children have one more byte. a and b count zeros and ones;
    w is the weight of the context's own estimate against that of its children:
    half its probability over the weighted one, half own plus half the children's product.
    """
    # Grams are dealt by context before each becomes eight rows; counting nodes then needs no shuffle of its own.
    seen = grams.where("n > 0").select(F.expr("gram >> 8").alias("ctx"), F.expr("cast(gram & 255 as int)").alias("byte"), "n").repartition("ctx")
    bits = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    node = F.expr("shiftleft(1, i) | shiftright(byte, 8 - i)")
    bit = F.expr("shiftright(byte, 7 - i) & 1")
    level = bits.groupBy("ctx", node.alias("node")).agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).cast("double").alias("b"))
    level = materialize(level.select("*", _estimate(F.col("a"), F.col("b")).alias("p"), F.lit(1.0).alias("w")))
    out = [level]
    for depth in range(DEPTH - 1, -1, -1):
        short = F.col("ctx").bitwiseAND(F.lit((1 << 8 * depth) - 1)).alias("ctx")
        up = level.groupBy(short, "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("p").alias("children"))
        up = up.withColumn("own", _estimate(F.col("a"), F.col("b")))
        top = F.greatest("own", "children")
        both = top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("children") - top)) - math.log(2)
        level = materialize(up.select("ctx", "node", "a", "b", both.alias("p"), F.exp(F.col("own") - math.log(2) - both).alias("w")))
        out.append(level)
    return [t.select("ctx", "node", "a", "b", "w") for t in out[::-1]]


def gram_scores(grams: DataFrame, tree: list[DataFrame]) -> DataFrame:
    """(gram, score): log10 probability of the last byte after the others, for every gram.

    At each binary decision the estimates of all depths are mixed, each with its weight. A context that training
    never saw has one half at all its depths: that is what the mixture below the deepest known one begins with.
    A context's nodes, 255 at most, are one row; a gram meets one row a depth, deepest first, and keeps eight numbers.
    """
    byte = F.expr("cast(gram & 255 AS int)")
    node = [F.shiftright(byte, 8 - i).bitwiseOR(F.lit(1 << i)) for i in range(8)]
    zero = [F.shiftright(byte, 7 - i).bitwiseAND(F.lit(1)) == 0 for i in range(8)]
    part = {"zero": F.expr("w * ((a + 0.5) / (a + b + 1))"), "one": F.expr("w * ((b + 0.5) / (a + b + 1))"), "rest": F.expr("1 - w")}
    entry = F.struct("node", F.struct(*[v.alias(k) for k, v in part.items()]).alias("s"))
    rows = grams.select("gram", F.expr("gram >> 8").alias("long"), *[F.lit(0.5).alias(f"m{i}") for i in range(8)])
    for depth, table in reversed(list(enumerate(tree))):
        known = table.groupBy(F.col("ctx").alias("c")).agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))
        if depth < 2:
            # One and 256 rows at most, whatever the data are; nearly all nodes are there, so they are an array by number.
            known = F.broadcast(known.select("c", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.try_element_at("nodes", k)).alias("nodes")))
        found = [F.get("nodes", k) if depth < 2 else F.try_element_at("nodes", k) for k in node]
        rows = rows.withColumn("c", F.col("long").bitwiseAND(F.lit((1 << 8 * depth) - 1))).join(known, "c", "left")
        rows = rows.select("gram", "long", *[f"m{i}" for i in range(8)], *[s.alias(f"s{i}") for i, s in enumerate(found)])
        own = [F.when(zero[i], F.col(f"s{i}.zero")).otherwise(F.col(f"s{i}.one")) for i in range(8)]
        rows = rows.select("gram", "long", *[F.coalesce(own[i] + F.col(f"s{i}.rest") * F.col(f"m{i}"), F.lit(0.5)).alias(f"m{i}") for i in range(8)])
    total = F.log10("m0")
    for i in range(1, 8):
        total = total + F.log10(f"m{i}")
    return rows.select("gram", total.alias("score"))


class _Grams:
    """Values of keys by open addressing: two to four slots a key, whatever the keys are."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            left = left[self.keys[at] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last
        self.value = np.zeros(1 << bits, values.dtype)
        self.value[slot] = values

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def values(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        away = np.flatnonzero(self.keys[slot] != keys)
        while len(away):
            slot[away] = (slot[away] + 1) & self.last
            away = away[self.keys[slot[away]] != keys[away]]
        return self.value[slot].astype(np.float64)

    def total(self, raw: bytes) -> float:
        return sum((float(self.values(_grams(np.frombuffer(raw[i : i + BATCH + DEPTH], np.uint8))).sum()) for i in range(0, len(raw) - DEPTH, BATCH)), 0.0)

    def totals(self, parts: list[bytes]) -> list[float]:
        """total() of every part; short ones are looked up together."""
        if sum(map(len, parts)) > 4 * BATCH:
            return [self.total(p) for p in parts]
        ends = np.cumsum([len(p) - DEPTH for p in parts])
        return np.add.reduceat(self.values(_collect(parts)), np.append(0, ends[:-1])).tolist()


def _dealt(docs: DataFrame, train: Column, chunks: int) -> DataFrame:
    """chunk, doc_id, text, train, copies: rows of docs, but such as are repeated more than HOT times once, with their number.

    Repeated rows of one id and text are in one chunk, so a chunk has HOT copies of a text at most.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text"))
    hot = materialize(rows.groupBy("place").count().where(F.col("count") > HOT).select("place"))
    once = rows.withColumn("copies", F.lit(1).cast("long"))
    if not hot.isEmpty():
        many = rows.join(hot, "place", "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("copies"))
        once = once.join(hot, "place", "left_anti").unionByName(many)
    return once.select(F.pmod("place", F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text", "train", "copies")


def score(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Counts are taken of all texts for which `train` holds. Documents are dealt to chunks by a hash;
    a chunk sends each of its distinct tokens and byte strings once, gets back its count or score
    over the whole corpus, and scores its texts with them. Counts are summed up with partial sums and
    joined back, which AQE splits where a token stands in very many chunks. So nothing that grows
    with the corpus is broadcast or sent to the driver, and no row is joined per occurrence. Tokens are known by 62 bits
    of XXH64.

    base_score: the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the text's tokens. score: log10
    of the probability that context-tree weighting gives the bytes of the same tokens, joined by
    spaces, with the end; contexts are DEPTH bytes at most. Null texts are empty: their only token is the end. Repeated rows are each
    learned and scored; null ids stay null; an empty table gives no row; with nothing to learn from
    every decision has probability one half.
    """
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    rows = _dealt(docs, train, chunks)
    counts = materialize(rows.select("chunk", "text", "train", "copies").groupBy("chunk").applyInPandas(_count_chunk, "chunk int, key long, n long"), "zstd")
    totals = materialize(counts.groupBy("key").agg(F.sum("n").alias("c")), "zstd")
    is_gram = F.col("key") >= F.lit(_GRAM)
    n_all, v_all = totals.where(~is_gram).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()

    grams = totals.where(is_gram).select(F.col("key").bitwiseXOR(F.lit(_GRAM)).alias("gram"), F.col("c").alias("n"))
    tree = context_tree(grams)
    with short_methods(docs.sparkSession):
        scores = materialize(gram_scores(grams, tree))
    for level in tree:
        discard(level)
    of_gram = scores.select(F.col("gram").bitwiseOR(F.lit(_GRAM)).alias("key"), F.col("score").alias("value"))
    of_key = totals.where(~is_gram).select("key", F.col("c").cast("double").alias("value")).union(of_gram)
    values = counts.select("chunk", "key").join(of_key, "key").select("chunk", "key", "value")
    below = math.log10(n_all + 0.5 * (v_all + 1))

    def score_chunk(pdf: pd.DataFrame, vals: pd.DataFrame) -> pd.DataFrame:
        keys, value = vals["key"].to_numpy(), vals["value"].to_numpy()
        gram = keys >= _GRAM
        tree, count = _Grams(keys[gram] ^ _GRAM, value[gram].astype(np.float32)), _Grams(keys[~gram], value[~gram])
        out = []
        for batch in _batches(pdf["text"], BATCH):
            c = count.values(_keys(batch))
            logs, known = (np.log10(c + 0.5) - below).tolist(), np.append(0, np.cumsum(c > 0)).tolist()
            end = 0
            for words, own in zip(batch, tree.totals([_bytes(words) for words in batch]), strict=True):
                start, end = end, end + len(words)
                out.append((len(words), known[end] - known[start], math.fsum(logs[start:end]), own))
        n, k, base, own = zip(*out, strict=True) if out else ((), (), (), ())
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "copies": pdf["copies"], "n_tokens": n, "n_known": k, "base_score": base, "score": own})

    left, right = rows.select("chunk", "doc_id", "text", "copies").groupBy("chunk"), values.groupBy("chunk")
    done = left.cogroup(right).applyInPandas(score_chunk, "doc_id long, copies long, n_tokens long, n_known long, base_score double, score double")
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """score() with a fold held out, and the column held_out."""
    held = fold(F.col("doc_id"), folds) == held_out
    return score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
