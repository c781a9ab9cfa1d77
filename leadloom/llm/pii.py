"""Personal data: base patterns, and a semi-Markov conditional random field that chooses boundaries and kinds jointly."""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: No entity: the label of the text between segments.
OUT = 4
#: Documents whose stretches the field learns from at most, about: those whose text hashes lowest.
TRAIN_ROWS = 20_000
#: Different lattices that the driver gets at most, and segments that one of them has at most.
TRAIN_LATTICES = 2_000
TRAIN_SEGMENTS = 64
#: Segments of an entity are at most this long; base spans may be longer.
LONGEST = 254
LONGEST_NUMBER = 64

# A match of these lies within a run of digits and the marks that part them.
_RUN = re.compile(r"[0-9][0-9+().\x20-]{5,}[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int("0516273849".index(d)) for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _valid(kind: int, s: str) -> bool:
    """Whether a match of a kind's pattern passes the kind's test."""
    if kind == IP:
        return all(map(_octet, s.split(".")))
    if kind == CARD:
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == EMAIL or 8 <= len(_digits(s)) <= 15


@dataclass
class Found:
    """What the patterns say of a text: base spans, matches that failed, and the stretches where entities can stand."""

    base: list[tuple[int, int, int]] = field(default_factory=list)
    failed: list[tuple[int, int, int]] = field(default_factory=list)
    stretches: list[tuple[int, int]] = field(default_factory=list)


def scan(text: str) -> Found:
    """The leftmost non-overlapping matches of every kind, in one pass over the text and one over each stretch.

    Time grows with the text's length whatever stands in it: a mail's domain is found first and its local
    part read backwards, and runs of digits are never tried twice.
    """
    out = Found()
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.base.append((EMAIL, start, end))
            out.stretches.append((start, m.end()))
    runs = []
    for m in _RUN.finditer(text):
        lo, hi = m.span()
        lo -= lo > 0 and text[lo - 1] == "+"
        runs.append((lo, hi))
        for kind, pattern in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
            for m in pattern.finditer(text, lo, hi):
                (out.base if _valid(kind, m[0]) else out.failed).append((kind, *m.span()))
    out.base.sort()
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(out.stretches + runs):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    out.stretches = merged
    return out


def _mails(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    at = text.find("@", lo, hi)
    while at >= 0:
        starts, i = [], at
        while i > max(lo, at - LONGEST) and text[i - 1] in _LOCAL:
            i -= 1
            if i == lo or not text[i - 1].isalnum():
                starts.append(i)
        ends, labels = [], 0
        m = _LABEL.match(text, at + 1, hi)
        while m and m.end() - at <= LONGEST:
            labels += 1
            if labels > 1:
                ends.append(m.end())
            m = _LABEL.match(text, m.end() + 1, hi) if text[m.end() : m.end() + 1] == "." else None
        yield from ((EMAIL, s, e) for s in starts for e in ends if e - s <= LONGEST)
        at = text.find("@", at + 1, hi)


def _numbers(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    groups = [m.span() for m in _DIGITS.finditer(text, lo, hi)]
    for i, (s, _) in enumerate(groups):
        plus = s > lo and text[s - 1] == "+"
        card = phone = dots = True
        count = 0
        for j in range(i, len(groups)):
            if j > i:
                gap = text[groups[j - 1][1] : groups[j][0]]
                card = card and gap in (" ", "-")
                dots = dots and gap == "."
                phone = phone and not gap.strip(" ().-")
            e = groups[j][1]
            count += e - groups[j][0]
            if count > 19 or e - s > LONGEST_NUMBER or not (card or dots or phone):
                break
            if dots and j == i + 3 and _valid(IP, text[s:e]):
                yield IP, s, e
            if card and count >= 16 and luhn(_digits(text[s:e])):
                yield CARD, s, e
            if plus and phone and 8 <= count <= 15 and e - s > 2:
                yield PHONE, s - 1, e


def segments(text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Every (kind, start, end) in a stretch that its kind's grammar allows, whichever others it overlaps."""
    return sorted({*_mails(text, lo, hi), *_numbers(text, lo, hi)}, key=lambda s: (s[1], s[2], s[0]))


def _side(text: str, at: int, step: int) -> str:
    """What stands beside a segment: the next mark, and whether a digit or letter follows it."""
    near = text[at] if 0 <= at < len(text) else ""
    far = text[at + step] if near and 0 <= at + step < len(text) else ""
    kind = lambda c: "end" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c if c in "+-.()@" else "!"
    return kind(near) + (kind(far) if near and not near.isalnum() else "")


def features(text: str, segment: tuple[int, int, int]) -> tuple[str, ...]:
    """Features of a whole segment: its outline, its counts of digits and parts, its length, and its sides."""
    kind, s, e = segment
    body = text[s:e]
    outline = re.sub(r"([9a])\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", body)))
    n = sum(map(str.isdigit, body))
    own = [
        "bias", "left " + _side(text, s - 1, -1), "right " + _side(text, e, 1), f"length {min(e - s, 40) // 4}",
        "outline " + (outline if kind != EMAIL else outline.split("@")[-1])[:40],
    ]
    if kind == EMAIL:
        own += [f"labels {min(body.count('.', body.index('@')), 6)}", f"top {min(len(body.rpartition('.')[2]), 8)}"]
    else:
        own += [f"digits {n}", f"parts {len(_DIGITS.findall(body))}", "groups " + "-".join(str(len(g)) for g in _DIGITS.findall(body))]
    return tuple(f"{KINDS[kind]} {f}" for f in own)


@dataclass
class Lattice:
    """A stretch as places 0..n and segments (from place, to place, kind, features), sorted by their starts.

    Between neighbouring places the text may be no entity. A path from the first place to the last is a
    segmentation: bounded entities and unbounded text between them.
    """

    n: int
    segments: list[tuple[int, int, int, tuple]]

    @classmethod
    def of(cls, text: str, lo: int, hi: int, given: list[tuple[int, int, int]]) -> Lattice:
        cuts = sorted({lo, hi, *(s for _, s, _ in given), *(e for _, _, e in given)})
        place = {c: i for i, c in enumerate(cuts)}
        return cls(len(cuts) - 1, [(place[s], place[e], k, features(text, (k, s, e))) for k, s, e in given])


@dataclass
class SemiMarkov:
    """score(path) = sum over its segments of the weights of their features, plus those of neighbouring labels.

    log_partition() sums over all paths and best() takes the best, both by dynamic programming over places
    and the label that ends there: time is (places + segments) x labels.
    """

    weights: dict[str, float]

    def step(self, before: int, kind: int) -> float:
        return self.weights.get(f"{before}>{kind}", 0.0)

    def score(self, feats: tuple) -> float:
        return sum(self.weights.get(f, 0.0) for f in feats)

    def _tables(self, lat: Lattice) -> tuple[list, list[list[int]]]:
        steps = [[self.step(a, b) if OUT not in (a, b) else 0.0 for b in range(5)] for a in range(5)]
        starting: list[list[int]] = [[] for _ in range(lat.n + 1)]
        for c, seg in enumerate(lat.segments):
            starting[seg[0]].append(c)
        return steps, starting

    def best(self, lat: Lattice) -> list[int]:
        """The segments of the best path. Of equally good ones, one with fewer, then earlier and longer segments."""
        steps, starting = self._tables(lat)
        low = (-math.inf,)
        top: list[list[tuple]] = [[low] * 5 for _ in range(lat.n + 1)]
        back: list[list[tuple | None]] = [[None] * 5 for _ in range(lat.n + 1)]
        top[0][OUT] = (0.0, 0, 0)
        for p in range(lat.n):
            here = [(v, k) for k, v in enumerate(top[p]) if v is not low]
            v, k = max(here)
            if v > top[p + 1][OUT]:
                top[p + 1][OUT], back[p + 1][OUT] = v, (p, k, None)
            for c in starting[p]:
                _, to, kind, feats = lat.segments[c]
                v, k = max(((v[0] + steps[k][kind], v[1], v[2]), k) for v, k in here)
                v = (v[0] + self.score(feats), v[1] - 1, v[2] - p * 2 + to - p)
                if v > top[to][kind]:
                    top[to][kind], back[to][kind] = v, (p, k, c)
        k, p, out = max(range(5), key=lambda k: top[lat.n][k]), lat.n, []
        while p:
            p, k, c = back[p][k]
            if c is not None:
                out.append(c)
        return out[::-1]

    def log_partition(self, lat: Lattice) -> tuple[float, dict[str, float]]:
        """Logarithm of the sum over all paths, and the expected count of every feature and step."""
        steps, starting = self._tables(lat)
        own = [self.score(s[3]) for s in lat.segments]
        fwd = np.full((lat.n + 1, 5), -np.inf)
        bwd = np.full((lat.n + 1, 5), -np.inf)
        fwd[0, OUT] = 0.0
        bwd[lat.n, :] = 0.0
        steps = np.array(steps)
        for p in range(lat.n):
            fwd[p + 1, OUT] = np.logaddexp(fwd[p + 1, OUT], np.logaddexp.reduce(fwd[p]))
            for c in starting[p]:
                _, to, kind, _ = lat.segments[c]
                fwd[to, kind] = np.logaddexp(fwd[to, kind], np.logaddexp.reduce(fwd[p] + steps[:, kind]) + own[c])
        for p in range(lat.n - 1, -1, -1):
            bwd[p, :] = bwd[p + 1, OUT]
            for c in starting[p]:
                _, to, kind, _ = lat.segments[c]
                bwd[p, :] = np.logaddexp(bwd[p, :], steps[:, kind] + own[c] + bwd[to, kind])
        whole = float(bwd[0, OUT])
        expected: dict[str, float] = {}
        for c, (p, to, kind, feats) in enumerate(lat.segments):
            each = np.exp(fwd[p] + steps[:, kind] + own[c] + bwd[to, kind] - whole)
            for f in feats:
                expected[f] = expected.get(f, 0.0) + float(each.sum())
            for k in range(OUT):
                if each[k] > 0:
                    expected[f"{k}>{kind}"] = expected.get(f"{k}>{kind}", 0.0) + float(each[k])
        return whole, expected


def observed(lat: Lattice, gold: list[int]) -> dict[str, float]:
    """Counts of the features and steps on one path."""
    out: dict[str, float] = {}
    end, last = -1, OUT
    for c in gold:
        p, to, kind, feats = lat.segments[c]
        for f in (*feats, *([f"{last}>{kind}"] if p == end else [])):
            out[f] = out.get(f, 0.0) + 1
        end, last = to, kind
    return out


def fit(examples: list[tuple[Lattice, list[int], float]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> SemiMarkov:
    """Gradient steps with AdaGrad on the log likelihood of the (lattice, segments of its path, weight) given.

    Without an example every weight is 0. The same examples give the same weights, in any order.
    """
    model = SemiMarkov({})
    examples = sorted(examples, key=lambda x: (x[0].n, x[0].segments, x[1]))
    total = sum(w for _, _, w in examples)
    seen = [observed(lat, gold) for lat, gold, _ in examples]
    squares: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for (lat, _, w), have in zip(examples, seen, strict=True):
            _, expected = model.log_partition(lat)
            for f, x in have.items():
                slope[f] = slope.get(f, 0.0) + w / total * x
            for f, x in expected.items():
                slope[f] = slope.get(f, 0.0) - w / total * x
        for f, g in sorted(slope.items()):
            g -= decay * model.weights.get(f, 0.0)
            squares[f] = squares.get(f, 1e-8) + g * g
            model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return model


def examples_of(text: str) -> Iterator[tuple[Lattice, list[int]]]:
    """Lattices of a text with the base spans as their paths.

    Left out are stretches that teach nothing or the wrong thing: without a segment, with overlapping or
    overlong base spans, with more segments than TRAIN_SEGMENTS, and those in which a match failed that
    holds a segment of its kind, as there the patterns may have missed it.
    """
    found = scan(text)
    for lo, hi in found.stretches:
        given = segments(text, lo, hi)
        inside = sorted((s for s in found.base if lo <= s[1] and s[2] <= hi), key=lambda s: s[1])
        if not given or len(given) > TRAIN_SEGMENTS or any(b[1] < a[2] for a, b in zip(inside, inside[1:])) or not set(inside) <= set(given):
            continue
        failed = [f for f in found.failed if lo <= f[1] and f[2] <= hi]
        if any(f[0] == s[0] and f[1] <= s[1] and s[2] <= f[2] for f in failed for s in given):
            continue
        yield Lattice.of(text, lo, hi, given), [given.index(s) for s in inside]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, lattices: int = TRAIN_LATTICES) -> SemiMarkov:
    """A field that learned from the base spans of about `rows` documents, those whose texts hash lowest.

    Equal lattices are summed up by Spark, so that copies of a text, however many, are one row; the
    driver gets `lattices` of them at most, each of bounded size. Their number counts by its logarithm.
    """
    share = min(1.0, rows / max(1, docs.count()))
    few = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [json.dumps([lat.n, lat.segments, gold]) for t in b.column(0) for lat, gold in examples_of(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["lattice"])

    counts = few.mapInArrow(run, "lattice string").groupBy("lattice").count()
    got = counts.orderBy(F.xxhash64("lattice"), "lattice").limit(lattices).collect()
    out = []
    for r in got:
        n, given, gold = json.loads(r["lattice"])
        out.append((Lattice(n, [(p, to, kind, tuple(feats)) for p, to, kind, feats in given]), gold, 1 + math.log(r["count"])))
    return fit(out)


def decode(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, further spans) as (kind, start, end), each in order.

    On every stretch the field chooses segments jointly, base spans among them; segments that overlap a
    base span are not open to it, so what it adds stands beside them. A field that learned nothing adds nothing.
    """
    found = scan(text)
    if not model.weights or not found.stretches:
        return found.base, []
    taken = sorted((s, e) for _, s, e in found.base)
    starts, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    base = set(found.base)
    more = []
    for lo, hi in found.stretches:
        def free(seg: tuple[int, int, int]) -> bool:
            i = bisect.bisect_left(starts, seg[2])
            return seg in base or i == 0 or reach[i - 1] <= seg[1]

        given = [s for s in segments(text, lo, hi) if free(s)]
        if all(s in base for s in given):
            continue
        more += [given[c] for c in model.best(Lattice.of(text, lo, hi, given)) if given[c] not in base]
    return found.base, sorted(more)


_SPANS = "array<struct<kind: string, start: bigint, stop: bigint, base: boolean>>"


def find_pii(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """docs' columns with `spans` added: kind, start, stop (code points, exclusive) and whether a pattern gave it.

    Spans are ordered by kind as in KINDS, then by start. Null and empty texts have none. A column named
    spans is replaced. One pass over whole texts, no shuffle; without a model, one is trained first.
    """
    model = train(docs) if model is None else model
    short_batches(docs.sparkSession)
    kept = docs.drop("spans")
    schema = kept.select("*", F.lit(None).cast(_SPANS).alias("spans")).schema
    names, at = list(kept.columns), kept.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at):
                base, more = decode(t.as_py() or "", model)
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                out.append([{"kind": KINDS[k], "start": s, "stop": e, "base": own} for k, s, e, own in both])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*names, "spans"])

    return kept.mapInArrow(run, schema)


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs.

    The counts and the digest are those of the base spans; spans holds the field's further ones, too, as
    kind:start:end. Null texts are empty; repeated rows each get a row, null ids stay; extra columns are
    ignored; an empty table gives no row.
    """
    found = find_pii(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS bigint) AS n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
