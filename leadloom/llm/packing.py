"""Packing of token ids into fixed windows: concatenate and cut, by two-pass prefix sums."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, short_batches

#: Ids of a document in one row of the token table at most; longer documents span several rows.
BLOCK = 65_536
#: Bytes of words with their ids that a Python worker keeps, about.
CACHE_BYTES = 64_000_000
#: Rows of partition totals that are broadcast at most (16 bytes each); more are joined by a shuffle.
MAX_BROADCAST_PARTS = 500_000
#: White space for Python but not for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters that Python lower-cases by other rules than the tokenizer, and the beginning of its special tokens.
_ODD_WORD = re.compile(r"[\u0130\u03a3]|<\|")
#: Fixed value: the tokenizer's own rule for units, for lower-case ASCII without white space.
_ASCII_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
TOKENS = "doc_id long, part int, doc_tokens long, doc_start long, local_start long, n long, ids binary"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class _Cache(dict):
    """Ids of texts, made when first asked for; about `limit` bytes are kept.

    A text that is asked for once is on trial in a quarter of the room, which is emptied when full;
    one that is asked for again stays, until the room is full and the older half goes.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.room, self.trial_room = make, limit, limit * 3 // 4, limit // 4
        self.trial: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        raw = self.trial.pop(text, None)
        if raw is not None:
            self[text] = raw
            self.room -= 200 + 3 * len(text) + len(raw)
            if self.room < 0:
                for k in list(islice(self, len(self) // 2)):
                    self.room += 200 + 3 * len(k) + len(self.pop(k))
            return raw
        raw = self.make(text)
        size = 200 + 3 * len(text) + len(raw)
        self.trial_room -= size
        if self.trial_room < 0:
            self.trial.clear()
            self.trial_room = self.limit // 4 - size
        if self.trial_room > 0:
            self.trial[text] = raw
        return raw


class WordTokenizer:
    """Ids of whole texts, by way of a cache of the ids of words between white space.

    The tokenizer composes characters (NFC), lower-cases them, drops white space and cuts the rest
    into units before it merges. So a text's ids are its words' ids in order. Words of letters only,
    once composed and lower-cased, are one unit, for which the merges alone are asked, as are the
    units of ASCII words; other words, among them those that Python lower-cases by other rules, and
    texts with U+001C to U+001F, which Python counts as white space, go through the whole tokenizer.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.model, self.letters = self.of.model, _byte_letters()
        self.units = _Cache(self._unit, cache_bytes // 8)
        self.words = _Cache(self._word, cache_bytes - cache_bytes // 8)

    @classmethod
    def kept(cls, path: str) -> WordTokenizer:
        """The one that this Python worker has used before, if any, with what it has kept."""
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.of.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        if not (unit.isascii() and unit.isprintable()):
            unit = "".join([self.letters[b] for b in unit.encode()])
        return array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._unit(word.lower())
        low = word if word.isascii() else unicodedata.normalize("NFC", word)
        if _ODD_WORD.search(low):
            return self.whole(word)
        low = low.lower()
        if low.isalpha():
            return self._unit(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return self.units[low[:-1]] + self.units[low[-1]]
        if low.isascii():
            return b"".join(map(self.units.__getitem__, _ASCII_UNIT.findall(low)))
        return self.whole(word)

    def encode(self, text: str | None, end_id: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of the text and end_id after them."""
        if not text:
            return end_id
        if _ODD_SPACE.search(text):
            return self.whole(text) + end_id
        if text.isascii() and "<|" not in text:
            text = text.lower()  # so that fewer words are to be kept
        return b"".join(map(self.words.__getitem__, text.split())) + end_id


_KEPT: dict[str, WordTokenizer] = {}


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """First pass: ids of every document in blocks, with their places in the task's own sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = WordTokenizer.kept(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                out: list[tuple] = []
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    raw = tok.encode(text, end)
                    n = len(raw) // 4
                    for s in range(0, n, BLOCK):
                        m = min(BLOCK, n - s)
                        out.append((key, part, n, s, at, m, raw[4 * s : 4 * (s + m)]))
                        at += m
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "part", "doc_tokens", "doc_start", "local_start", "n", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    All documents' ids stand in one sequence, cut every `window` ids; only the last window can be
    short. Pass one tokenizes once and writes the ids with offsets inside their task's partition to
    a table in the shared folder. The totals of partitions, one row for each, are summed up to
    global offsets. Pass two adds them and cuts; a document that crosses a boundary gives a piece on
    each side. Null texts are empty: their piece is the end id alone. A null doc_id stays null,
    repeated rows are packed each for itself, other columns are ignored, an empty table gives no row.
    """
    short_batches(docs.sparkSession)
    table = materialize(token_table(docs, tokenizer_path, end_id), "zstd")
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    bases = materialize(bases)
    if bases.count() <= MAX_BROADCAST_PARTS:
        bases = F.broadcast(bases)
    at = table.join(bases, "part").withColumn("g", F.col("base") + F.col("local_start"))
    w = F.lit(window).cast("long")
    at = at.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"g div {window}"), F.expr(f"(g + n - 1) div {window}"))))
    first = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * w - F.col("g"))
    at = at.withColumn("first", first).withColumn("offset", F.col("g") + F.col("first") - F.col("sequence_id") * w)
    at = at.withColumn("length", F.least(F.col("n") - F.col("first"), w - F.col("offset")))
    return at.select(
        "doc_id",
        (F.col("doc_start") + F.col("first")).alias("start"),
        "length",
        F.expr("substring(ids, cast(first * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
