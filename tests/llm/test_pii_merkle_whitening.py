"""Personal data, manifests and whitening against brute force, and on odd rows and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from leadloom.llm import merkle, pii, whitening

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, spans int, size int, base string, leaf string"
TEXTS = [
    None,
    "",
    "a\nb\n",
    "Mail x.y+z@mail.example.com or +1 (269) 555-3296 4524132264652876 and 42.144.35.254, é a@1.2.3.4 999.1.1.1",
    "clean words only",
    "x" * 70_000 + "@" + "\n" * 70_000,
    "1 " * 20_000,
]


def table(spark, n=700):
    rows = []
    for k in range(n):
        t = TEXTS[k % len(TEXTS)] if k < 21 else f"text {k}\n of +4{k % 9} 30 12345{k:03d} end"
        source = None if k % 50 == 0 else "" if k % 50 == 1 else "hot" if k % 3 else f"söurce{k % 7}"
        rows.append((None if k % 97 == 5 else k // 2, t, None if k % 5 == 0 else "en", source, None if t is None else len(t), "x", 1, 2, 3, "y", "z"))
    rows += [rows[10]] * 300
    return spark.createDataFrame(rows, KIND).repartition(5)


# ---- manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(digests):
    """The last node, and for every leaf its (siblings before, after) on each level."""
    paths, under = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        runs = [range(k, min(k + 3, len(digests))) for k in range(0, len(digests), 3)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    paths[leaf].append(("".join(digests[run.start : k]), "".join(digests[k + 1 : run.stop])))
        under = [[leaf for k in run for leaf in under[k]] for run in runs]
        digests = [_h(*(digests[k] for k in run)) for run in runs]
    return digests[0], paths


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
        built.append(_tree([_leaf(r, r["text"]) for r in by[s]]))
    root, above = _tree([b[0] for b in built])
    for s, (subroot, paths), up in zip(names, built, above, strict=True):
        for r, own in zip(by[s], paths, strict=True):
            leaf = read = _leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                read = _leaf(r, r["text"].replace("\n", ""))
            for before, after in own + up:
                read = _h(before, read, after)
            yield r["doc_id"], leaf, subroot, root, _h(*(b + a for b, a in own + up)), read, read == root


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_manifest_equals_brute_force(spark, n):
    docs = table(spark, 700) if n == 700 else table(spark, 21).limit(n)
    docs = spark.createDataFrame(docs.collect(), KIND)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = merkle.manifest(docs).select(*names).collect()
    want = list(brute_manifest([r.asDict() for r in docs.collect()])) if n else []
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_blocks_combine_in_any_order_and_in_parts():
    digests = {k: _h(str(k)) for k in range(200)}
    want = _tree(list(digests.values()))[0]
    order = list(digests)
    random.Random(1).shuffle(order)
    parts = [merkle._Partial(200) for _ in range(4)]
    for n, k in enumerate(order):
        parts[n % 4].arrive(k, digests[k])
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert not whole.waiting
    assert whole.levels()[-1] == [want]


def test_a_changed_sibling_or_leaf_is_not_verified(spark):
    docs = table(spark, 50)
    rows = docs.selectExpr("doc_id", "source", "sha2(coalesce(text, ''), 256) AS leaf")
    m = merkle.build(rows, "source", "doc_id")
    proofs = m.proofs()
    assert {r["root"] for r in proofs.select("root").distinct().collect()} == {m.root()}
    assert merkle.verify(proofs).where("NOT verified").isEmpty()
    assert merkle.verify(proofs.selectExpr("*", "sha2(leaf, 256) AS other"), "other").where("verified").isEmpty()
    assert merkle.verify(proofs.selectExpr("* EXCEPT (lefts)", "transform(lefts, x -> concat(x, '0')) AS lefts")).where("verified").isEmpty()


# ---- personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute_spans(text):
    return sorted((k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if _passes(k, m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    bits = ["+1 (988) 555-2485", "4404041894974608795", "4041894974608795", "4111 1111 1111 1111", "1.2.3.4", "42.144.35.254", "999.1.1.1", "a.b@c.d", "x@y", "@", "+", "(", "-", " ", " ", "é", "7", "12", ".", "\n", "a@1.2.3.4", "+49 30 1234567", "%"]
    for _ in range(5_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.scan(t).base == brute_spans(t), t


def test_scans_are_linear():
    for t in ("1" * 400_000, "1 " * 200_000, "a" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" + " " * 400_000):
        pii.scan(t)


def _paths(lat):
    """Every choice of segments that don't overlap, in order."""
    for k in range(len(lat.segments) + 1):
        for chosen in itertools.combinations(range(len(lat.segments)), k):
            own = [lat.segments[c] for c in chosen]
            if all(a[1] <= b[0] for a, b in itertools.pairwise(own)):
                yield list(chosen)


def _score(model, lat, path):
    return sum(model.weights.get(f, 0.0) * n for f, n in pii.observed(lat, path).items())


def test_dynamic_programs_equal_enumeration():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 6)
        segs = sorted({(a, b, rng.randrange(4)) for a, b in (sorted(rng.sample(range(n + 1), 2)) for _ in range(rng.randint(0, 6)))})
        lat = pii.Lattice(n, [(a, b, k, (f"f{rng.randrange(5)}", f"g{k}")) for a, b, k in segs])
        names = [f"f{k}" for k in range(5)] + [f"g{k}" for k in range(4)] + [f"{a}>{b}" for a in range(4) for b in range(4)]
        model = pii.SemiMarkov({f: rng.uniform(-2, 2) for f in names})
        scores = [_score(model, lat, p) for p in _paths(lat)]
        whole, expected = model.log_partition(lat)
        assert math.isclose(whole, math.log(sum(map(math.exp, scores))), abs_tol=1e-9)
        assert math.isclose(_score(model, lat, model.best(lat)), max(scores), abs_tol=1e-9)
        mean = {}
        for p, s in zip(_paths(lat), scores, strict=True):
            for f, c in pii.observed(lat, p).items():
                mean[f] = mean.get(f, 0.0) + c * math.exp(s - whole)
        assert all(math.isclose(expected.get(f, 0.0), x, abs_tol=1e-9) for f, x in mean.items())


def test_the_field_parts_what_the_patterns_run_together():
    train = [f"text {w} +1 ({k:03d}) 555-{k}{k % 10} and {w} 4524132264652876 more {w}.{k}@mail.example.com, 10.0.{k % 9}.7 end" for k, w in enumerate(["foo", "bar", "baz"] * 30, 100)]
    seen = {}
    for t in train:
        for lat, gold in pii.examples_of(t):
            seen[repr((lat, gold))] = (lat, gold, 1.0)
    model = pii.fit(list(seen.values()))
    text = "call +1 (269) 555-3296 4524132264652876 and go"
    base, more = pii.decode(text, model)
    assert base == []
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in more] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    assert pii.decode("clean words 2024, 12 of 300", model) == ([], [])
    assert pii.decode(text, pii.fit([])) == ([], [])


def test_pii_of_odd_rows(spark):
    docs = table(spark, 60)
    rows = {(r["doc_id"], r["spans"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.pii(docs).collect()}
    want = set()
    for r in docs.collect():
        base = brute_spans(r["text"] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        want.add((r["doc_id"], hashlib.sha256(joined.encode()).hexdigest(), *(sum(k == b[0] for b in base) for k in range(4)), joined))
    assert {(r[0], *r[2:]) for r in rows} == {w[:-1] for w in want}
    for doc_id, spans, sha, *_ in rows:
        kept = {w[-1] for w in want if w[0] == doc_id and w[1] == sha}
        assert any(set(filter(None, k.split(","))) <= set(spans.split(",")) for k in kept)
    assert pii.pii(docs.limit(0)).isEmpty()
    again = pii.find_pii(docs, pii.SemiMarkov({}))
    assert again.columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    assert again.where("exists(spans, s -> NOT s.base)").isEmpty()


# ---- whitening


def test_exact_products_of_any_size():
    rng = np.random.default_rng(2)
    for top in (3, 1 << 20, 1 << 40, 1 << 62):
        y = rng.integers(-top, top, (70, 5), endpoint=True)
        exact = y.astype(object)
        assert (whitening.gram(y) == exact.T @ exact).all()


def brute_whitening(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), sum(x)
    centred = x * n - s
    v = np.array([[e / n**3 for e in row] for row in (centred.T @ centred).tolist()])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    return [int(sum(c * c)) for c in centred], (centred / n).astype(float) @ (axes / np.sqrt(values)), values / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    good = [(k, [float(c) for c in rng.normal(0, 1 + k % 3, 40)]) for k in range(300)] + [(7, [1.0] * 40), (None, [2.0] * 39 + [-5.0])]
    odd = [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [1.0] * 39 + [float("nan")]), (904, [float("inf")] * 40), (905, [1.0] * 8)]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in good + odd], "vec_id long, embedding array<float>, n int, component int").repartition(6)
    single = [(k, np.array(v, np.float32).astype(float)) for k, v in good]
    deviation, white, share = brute_whitening([v for _, v in single])
    got = whitening.whiten(df).collect()
    assert len(got) == 32 * len(good)
    assert {r["n"] for r in got} == {len(good)}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    assert max(abs(r["explained"] / share[r["component"] - 1] - 1) for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), {})[r["component"]] = r["whitened"]
    signs = None
    for (k, _), d, w in zip(single, deviation, white, strict=True):
        mine = np.array([by[k, d][c] for c in range(1, 33)])
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine, signs * w, atol=1e-9)


def test_whitening_of_huge_entries_and_degenerate_tables(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1e300, 2.0]), (2, [-1e300, 3.5]), (3, [0.25, -7.0]), (4, [12.0, 1e17])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    clamp = lambda c: max(-(2**62), min(2**62, math.floor(64 * c) if abs(c) < 1e200 else int(math.copysign(2**62, c))))
    x = np.array([[clamp(c) for c in v] for _, v in rows], object)
    centred = x * 4 - sum(x)
    want = {k: int(sum(c * c)) for (k, _), c in zip(rows, centred, strict=True)}
    assert {(r["vec_id"], int(r["deviation"])) for r in got if r["deviation"] is not None} == {(k, d) for k, d in want.items() if d < 10**38}
    assert all(r["deviation"] is None for r in got if want[r["vec_id"]] >= 10**38)
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(few, kind)).isEmpty()
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], kind)).collect()
    assert {r["component"] for r in flat} == {1} and math.isclose(flat[0]["explained"], 1.0)
