"""Edge cases and brute-force comparisons of the training-data operators, on small tables."""

import collections
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import common, decontaminate, langid, licenses, lm, packing, sharding, simhash, substrings, suffixes, toxicity, vectors
from leadloom.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


DOCS = [
    (0, "Released under the MIT License. " + text(1, 40)),
    (1, None),
    (2, ""),
    (3, text(2, 80)),
    (4, text(2, 80)),  # a copy
    (5, text(2, 40) + " changed " + text(3, 60)),
    (6, "!!! 123 ???"),
    (7, "é" * 300 + " " + text(2, 80)),
    (8, "ab" * 300),
    (9, text(9, 20_000)),
    (None, text(4, 30)),
    (3, text(2, 80)),  # a repeated row
    (10, "General  Public\nLicense, apache license MIT license"),
]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session).startswith("file:")


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use themselves."""
    rows = [(k, t, "en", "s", len(t or ""), 1, 2, 3) for k, t in DOCS]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, key int, span int"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x))


ALL = sorted((k for k, _ in DOCS), key=lambda x: (x is not None, x))


def test_licenses(docs, empty):
    got = licenses.scan_licenses(docs).collect()
    assert ids(licenses.scan_licenses(docs)) == ALL
    by = {r["doc_id"]: r for r in got}
    assert (by[0]["base_labels"], by[0]["n_base"], by[0]["first_word"], by[0]["last_word"]) == ("mit", 1, 3, 3)
    assert by[10]["base_labels"] == "apache,gpl,mit" and by[10]["n_base"] == 3 and (by[10]["first_word"], by[10]["last_word"]) == (0, 5)
    assert by[1]["n_words"] == 0 and by[1]["labels"] == "" and by[1]["score"] == 0 and by[1]["first_word"] is None
    assert by[9]["n_words"] == 20_000
    assert licenses.scan_licenses(empty).count() == 0


def test_license_near_misses_get_no_label(spark):
    texts = {
        "Released under the Apache License version 1": "apache",
        "the book was released last week and is under no license at all": "",
        "this work is licensed under the general public license version 2": "gpl",
        "this work is licensed under a permissive license by the House of Commons for international use": "",
        "Permission to copy this software and any files is granted to a person free of charge, with documentation": "",
        "you may not use this license of the file except a copy you obtain in the compliance office at noon with": "",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "Permission is hereby granted, free of charge, to any person who gets a copy of this software and associated documentation files": "mit",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc",
        "x " * 120 + "Redistribution and use in source and binary forms, with or without modification, are permitted if the following conditions are met": "bsd",
        "All  rights\nreserved": "all-rights-reserved",
    }
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: texts[t] for k, t in rows}


def test_license_templates_by_brute_force(spark):
    rng = np.random.default_rng(5)
    ts = (licenses.Template("a", ("red", "green", "blue", "red")), licenses.Template("b", ("blue", "black"), exact=True, base=True), licenses.Template("c", ("red", "white", "grey"), ("white", "grey")))
    rows = [(k, " ".join(rng.choice(["red", "green", "blue", "black", "white", "grey"], rng.integers(0, 30)))) for k in range(60)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ts, 0.6, 4).collect()}
    for k, t in rows:
        w = t.split()
        a = max([len({"red", "green", "blue"} & set(w[s : s + 8])) / 3 for s in range(0, max(1, len(w)), 4)])
        b = [i for i in range(len(w) - 1) if w[i : i + 2] == ["blue", "black"]]
        named = [x for s in range(0, max(1, len(w)), 4) if any((x := w[s : s + 8])[i : i + 2] == ["white", "grey"] for i in range(7))]
        c = max([len({"red", "white", "grey"} & set(x)) / 3 for x in named], default=0)
        labels = ",".join((["a"] if a >= 0.6 else []) + (["b"] if b else []) + (["c"] if c >= 0.6 else []))
        assert (got[k]["labels"], got[k]["n_base"]) == (labels, len(b))
        assert got[k]["score"] == pytest.approx(max([a] * (a >= 0.6) + [1.0] * bool(b) + [c] * (c >= 0.6) + [0.0]))


def test_sharding(docs, empty):
    table = sharding.fill_table([f"s{k}" for k in range(7)], 211)
    assert set(np.bincount(table)) <= {30, 31}
    more = sharding.fill_table([f"s{k}" for k in range(8)], 211)
    moved = sum(a != b for a, b in zip(table, more, strict=True) if b != 7)
    assert moved < 40
    got = sharding.assign_shards(docs, "doc_id", ["a", "b", "c"], 101)
    assert ids(got) == ALL and got.where("shard is null").count() == 0
    assert got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.assign_shards(empty, "doc_id", ["a"], 2).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 11)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 12)


def test_packing_is_an_exact_round_trip(docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 1000)
    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    pieces = sorted(packing.pack(docs, path, window=256).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in pieces:
        assert r["sequence_id"] * 256 + r["offset"] == at and len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 256
        at += r["length"]
    want = collections.Counter((k, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in DOCS)
    got, parts, n = collections.Counter(), [], 0
    for r in pieces:  # the ids of a document stand one after the other
        assert r["start"] == n
        parts.append(np.frombuffer(bytes(r["ids"]), "<u4"))
        n += r["length"]
        if n == r["doc_tokens"]:
            got[(r["doc_id"], tuple(np.concatenate(parts).tolist()))] += 1
            parts, n = [], 0
    assert got == want
    assert packing.pack(empty, path).count() == 0


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for t in ("It's DON'T, İstanbul ΣΑΣ. ß straße", "a\x1cb c", "été <|endoftext|> x", "日本 12.5, 'll ''s", "    ", "A.B.,", "ǅ ﬁ Å"):
        assert own.encode(t, b"") == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_every_code_point_has_the_tokenizers_ids():
    path = tokenizer_path()
    own = packing.WordTokenizer(path, cache_bytes=200_000)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{0} a{0}b", "1{0}. {0}A,"):
        texts = [" ".join(form.format(c) for c in points[k : k + 32]) for k in range(0, len(points), 32)]
        for t, want in zip(texts, own.of.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(t, b"") == np.asarray(want.ids, "<u4").tobytes(), t


def test_word_cache_is_bounded():
    cache = packing._Cache(lambda t: t.encode() * 2, 20_000)
    rng = np.random.default_rng(1)
    for k in rng.zipf(1.3, 20_000):
        assert cache[f"w{k}"] == f"w{k}".encode() * 2
        assert len(cache) + len(cache.trial) < 100
    assert cache["x" * 50_000] == b"x" * 100_000 and not any(len(k) > 1000 for k in [*cache, *cache.trial])


def brute_components(fps):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs)
    assert ids(got) == ALL
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == 1
    assert by[3]["component_id"] == by[4]["component_id"] == 3
    h = [xxhash.xxh64_intdigest("general public license,", 42), xxhash.xxh64_intdigest("public license, apache", 42), xxhash.xxh64_intdigest("license, apache license", 42), xxhash.xxh64_intdigest("apache license mit", 42), xxhash.xxh64_intdigest("license mit license", 42)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 5)
    assert by[10]["fingerprint"] == f"{want:016x}"
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [2, 3, 2048])
def test_simhash_links_find_all_components(spark, bucket):
    rng = np.random.default_rng(bucket)
    fps = {}
    for c in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps[x - 2**64 if x >= 2**63 else x] = None
    fps = {k: k % 2**64 for k in fps}
    df = spark.createDataFrame([(k,) for k in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.connected_components(simhash.links(df, bucket)).collect()}
    got = {k: roots.get(k, k) for k in fps}
    want = brute_components(fps)
    assert len({(got[k], want[k]) for k in fps}) == len(set(got.values())) == len(set(want.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got[k] for k in range(41)) == {0} and set(got[k] for k in range(100, 160)) == {100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for k in range(400):
        t = rng.integers(0, [2, 3, 6, 5000][k % 4], rng.integers(0, 60))
        t = np.tile(t, 3) if k % 5 == 0 else t
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    t = np.tile(rng.integers(0, 3000, 700), 3)  # deep recursion over large alphabets
    assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffixes.suffix_array(np.zeros(5000, int)).tolist() == list(range(4999, -1, -1))


def test_repeats_within_a_task_are_told_by_place():
    seen = substrings._Seen(most=3)
    cell = lambda rows: {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("anchor", "content", "check", "n", "key", "text_id", "s"))}
    assert seen.again(cell([(1, 7, 7, 2, 5, 0, 0), (1, 7, 7, 2, 3, 0, 9), (1, 7, 7, 2, 3, 0, 9), (1, 8, 8, 2, 9, 0, 0)])).tolist() == [True, False, False, False]
    assert seen.again(cell([(1, 7, 7, 2, 4, 0, 0), (1, 7, 7, 2, 2, 0, 0), (1, 8, 8, 2, 9, 9, 9)])).tolist() == [True, False, False]
    assert seen.again(cell([(1, 7, 7, 2, 3, 0, 9)])).tolist() == [True]
    assert seen.again(cell([])).tolist() == []


@pytest.mark.parametrize("hot", [8_000_000, 300])
def test_substrings(docs, empty, hot):
    rows = {(common.NULL_ID if k is None else k): (t or "").encode() for k, t in DOCS}
    want = substrings.brute_force(list(rows.items()))
    done = substrings.remove_repeats(docs.drop("kept"), hot_bytes=hot, shard_bytes=2000).collect()
    assert len(done) == len(DOCS)
    for r in done:
        n, removed, spans, sha = want[common.NULL_ID if r["doc_id"] is None else r["doc_id"]]
        left = bytes(r["kept"])
        assert (n - len(left), r["n_spans"]) == (removed, spans)
        import hashlib

        assert hashlib.sha256(left).hexdigest() == sha
    assert substrings.repeat_digests(empty).count() == 0
    assert substrings.without_repeats(docs).columns == docs.columns


def test_substrings_of_random_repeats(spark):
    rng = np.random.default_rng(3)
    pool = [bytes(rng.integers(97, 99 if k % 3 else 123, 90 + 30 * k, np.uint8)).decode() for k in range(8)]
    rows = [(k, "".join(rng.choice(pool)[rng.integers(0, 40) :] for _ in range(rng.integers(0, 6)))) for k in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == substrings.brute_force([(k, t.encode()) for k, t in rows])


@pytest.mark.parametrize("hot", [8_000_000, 300])
def test_substrings_of_texts_that_share_an_id(spark, hot):
    rng = np.random.default_rng(6)
    pool = [bytes(rng.integers(97, 123, 120 + 20 * k, np.uint8)).decode() for k in range(6)]
    rows = [(None if k % 3 == 0 else k // 4, "".join(rng.choice(pool)[rng.integers(0, 20) :] for _ in range(rng.integers(1, 4)))) for k in range(60)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (0, rows[1][1])]  # repeated rows, and texts under two ids
    key = lambda k, t: (common.NULL_ID if k is None else k, int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64)))
    want = substrings.brute_force(list({key(k, t): t.encode() for k, t in rows}.items()))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot_bytes=hot, shard_bytes=2000).collect()
    assert len(got) == len(rows) and len(want) < len(rows)
    for r in got:
        n, removed, spans, _ = want[key(r["doc_id"], r["text"])]
        assert (n - len(r["kept"]), r["n_spans"]) == (removed, spans)


def test_lm(docs, empty):
    got = lm.score(docs, F.coalesce(F.col("doc_id") != 5, F.lit(True))).collect()
    assert len(got) == len(DOCS)
    counts = collections.Counter()
    for k, t in DOCS:
        if k != 5:
            counts.update(lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = collections.defaultdict(list)
    for k, t in DOCS:
        texts[k].append(t)
    for r in got:
        w = lm.tokens(texts[r["doc_id"]][0])
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert lm.lm_scores(empty).count() == 0


def brute_ctw(train, queries, depth):
    """log10 probability of each byte of each query by the same mixture, over dictionaries."""
    ab = collections.defaultdict(lambda: [0, 0])
    for t in train:
        for i in range(depth, len(t)):
            for d in range(depth + 1):
                node = 1
                for s in range(7, -1, -1):
                    bit = t[i] >> s & 1
                    ab[t[i - d : i], node][bit] += 1
                    node = 2 * node + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    pw, weight, sums = {}, {}, collections.defaultdict(float)
    for d in range(depth, -1, -1):
        for (c, node), (a, b) in [x for x in ab.items() if len(x[0][0]) == d]:
            own = kt(a, b)
            both = own if d == depth else math.log(0.5) + np.logaddexp(own, sums[c, node])
            pw[c, node], weight[c, node] = both, 1.0 if d == depth else math.exp(own + math.log(0.5) - both)
            if d:
                sums[c[1:], node] += both
    out = []
    for t in queries:
        total = 0.0
        for i in range(depth, len(t)):
            node = 1
            for s in range(7, -1, -1):
                bit = t[i] >> s & 1
                p = 0.5  # what every context that training never saw gives
                for d in range(depth, -1, -1):
                    key = (t[i - d : i], node)
                    if key in ab:
                        own = (ab[key][bit] + 0.5) / (sum(ab[key]) + 1)
                        p = weight[key] * own + (1 - weight[key]) * p
                total += math.log10(p)
                node = 2 * node + bit
        out.append(total)
    return out


def test_lm_equals_brute_force(spark):
    rows = [(k, text(k, 25) + " x" * k) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") % 3 != 0, chunk_bytes=700).collect()}
    train = [lm._bytes(lm.tokens(t)) for k, t in rows if k % 3]
    want = brute_ctw(train, [lm._bytes(lm.tokens(t)) for _, t in rows], lm.DEPTH)
    assert [got[k] for k in range(12)] == pytest.approx(want, rel=1e-5)


def test_lm_counts_hot_rows_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 3)
    rows = [(1, "same words here")] * 40 + [(2, "same words")] * 2 + [(3, "other")] + [(None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    few = lm._dealt(df, F.lit(True), 5)
    assert sorted((r["doc_id"] or 0, r["copies"]) for r in few.collect()) == [(0, 9), (1, 40), (2, 1), (2, 1), (3, 1)]
    got = lm.score(df, F.lit(True), chunk_bytes=100).collect()
    monkeypatch.setattr(lm, "HOT", 1000)
    want = lm.score(df, F.lit(True), chunk_bytes=100).collect()
    assert len(got) == len(want) == 52
    key = lambda r: (r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 5))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_lm_tables_take_any_alphabet():
    rng = np.random.default_rng(3)
    for symbols in (2, 256):
        raw = rng.integers(0, symbols, 30_000).astype(np.uint8).tobytes()
        keys = np.unique(lm._grams(np.frombuffer(raw, np.uint8)))
        values = rng.random(len(keys)).astype(np.float32)
        table = lm._Grams(keys, values)
        want = values[np.searchsorted(keys, lm._grams(np.frombuffer(raw, np.uint8)))].sum(dtype=np.float64)
        assert table.total(raw) == pytest.approx(want) and len(table.keys) <= 4 * len(keys) + 16
    assert lm._Grams(np.empty(0, np.int64), np.empty(0)).total(b"") == 0


def test_lm_counts_and_totals_of_batches_stop_at_texts(monkeypatch):
    import pandas as pd

    rows = [("ab ab", True, 1), ("", True, 1), (None, False, 1), ("ab c", True, 3), ("d" * 40, False, 1)]
    want = collections.Counter()
    for t, train, copies in rows:
        raw = lm._bytes(lm.tokens(t))
        for k in [int(x) for x in lm._keys([lm.tokens(t)])] + [int.from_bytes(raw[i - lm.DEPTH : i + 1]) | lm._GRAM for i in range(lm.DEPTH, len(raw))]:
            want[k] += copies * train
    got = lm._count_chunk(pd.DataFrame(rows, columns=["text", "train", "copies"]).assign(chunk=0))
    assert dict(zip(got["key"].tolist(), got["n"].tolist(), strict=True)) == dict(want)
    parts = [lm._bytes(lm.tokens(t)) for t, _, _ in rows]
    keys = np.unique(lm._collect(parts))
    table = lm._Grams(keys, np.arange(1, len(keys) + 1, dtype=np.float32))
    single = [table.total(p) for p in parts]
    assert table.totals(parts) == pytest.approx(single)
    monkeypatch.setattr(lm, "BATCH", 4)
    assert table.totals(parts) == pytest.approx(single)


def test_lm_scores_byte_strings_in_methods_that_the_jvm_compiles(spark, monkeypatch):
    """The columns of several depths were one generated method, too long to be compiled."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before, seen, plan = spark.conf.get(key), [], lm.gram_scores
    monkeypatch.setattr(lm, "gram_scores", lambda *a: seen.append(spark.conf.get(key)) or plan(*a))
    lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True))
    assert seen == ["8000"] and spark.conf.get(key) == before


def test_buckets_that_share_a_hash_are_told_apart():
    import pyarrow as pa

    group = pa.table({"c": [1, 2, 3, 4, 5], "label": ["a", "b", "a", "a", "b"], "v": [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0], [0.0, 1.0]]})
    assert sorted(t.column("c").to_pylist() for t in vectors._alike(group)) == [[1, 3], [2, 5], [4]]
    assert [t.num_rows for t in vectors._alike(group.slice(0, 1))] == [1]


def test_toxicity_learns_from_one_row_of_an_id(spark):
    rows = [(5, f"hot row {k}") for k in range(3000)] + [(k, f"plain {k}") for k in range(10, 30)]
    labels = [(5, 1, 1), (11, 1, 0), (12, 1, 0)]
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda docs, y, *a, **k: seen.append(list(y))
    try:
        toxicity.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held_out=7)
    finally:
        toxicity.fit = fit
    assert sorted(seen[0]) == [0, 0, 1]


def test_toxicity(spark, docs, empty):
    rows = [(k, text(k, 60) + (" awful" if k % 4 == 0 else "") + (" scum" if k % 8 == 0 else "")) for k in range(400)]
    lab = [(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (9999, 1, 1), (5, 1, None)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) == int(r["score"] >= 0.5) for r in held)
    assert ids(toxicity.toxicity(docs, labels)) == ALL
    assert toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.toxicity(empty, labels).count() == 0


def test_factorization_machine_learns_pairs():
    """Neither word alone is toxic, both together are."""
    both, words = [], []
    rng = np.random.default_rng(2)
    for _ in range(600):
        a, b = (bool(x) for x in rng.random(2) < 0.5)
        words.append(toxicity.terms(" ".join(["insult"] * a + ["group"] * b + list(rng.choice(WORDS, 5)))))
        both.append(int(a and b))
    m = toxicity.fit(words, both)
    p = {t: m.score(t) for t in ("insult group", "insult", "group", "")}
    assert p["insult group"] > 0.5 > max(p["insult"], p["group"], p[""])


def test_factorization_machine_learns_exclusive_terms():
    """Neither word alone is associated with the label, only the pair is."""
    rng = np.random.default_rng(1)

    def rows(n):
        pairs = [tuple(map(bool, rng.random(2) < 0.5)) for _ in range(n)]
        return [toxicity.terms(" ".join(["insult"] * a + ["group"] * b + list(rng.choice(WORDS, 20)))) for a, b in pairs], [int(a != b) for a, b in pairs]

    m = toxicity.fit(*rows(2000))
    docs, y = rows(400)
    assert np.mean([(m.margin(d) > 0) == v for d, v in zip(docs, y, strict=True)]) > 0.95


def test_factorization_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.FactorizationMachine(0.3, rng.normal(size=toxicity.SLOTS).astype(np.float32), rng.normal(size=(toxicity.SLOTS, 4)).astype(np.float32))
    for n in (0, 1, 2, 30):
        s = toxicity.terms(text(n, n))
        want = 0.3 + sum(float(m.linear[i]) for i in s) + sum(float(np.dot(m.factors[i].astype(float), m.factors[j])) for k, i in enumerate(s) for j in s[:k])
        assert m.margin(s) == pytest.approx(want, abs=1e-6)
        assert m.score(text(n, n)) == pytest.approx(1 / (1 + math.exp(-want)) if abs(want) < 30 else float(want > 0), abs=1e-9)
    for slots in (s, np.arange(0, toxicity.SLOTS, 3, dtype=np.uint32), np.empty(0, np.uint32)):
        assert toxicity._unpacked(toxicity._packed(slots)).tolist() == slots.tolist()


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(90):
        v = base[k % 12] + rng.normal(size=16) * (0.02 if k % 3 else 0.3)
        rows.append((k, v.tolist(), k % 2))
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0, None] * 8, 1), (104, base[0].tolist(), None), (105, [], 1), (106, [1.0, 2.0], 1), (107, [2.0, 4.0], 1), (None, rows[1][1], 1), (1, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, c int, m int")
    for piece in (512, 4):
        got = vectors.near_duplicates(df, piece=piece).collect()
        assert len(got) == len(rows)
        usable = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
        links = collections.Counter()
        for n, (i, a, g) in enumerate(usable):
            links[i] += sum(a.shape == b.shape and g == h and a @ b >= 0.98 for m, (_, b, h) in enumerate(usable) if m != n)
        have = collections.Counter()
        for r in got:
            have[r["vec_id"]] += r["n_links"]
        assert sum(have.values()) >= 0.95 * sum(links.values()) and all(have[k] <= links[k] for k in have)
        assert have[106] == have[107] == 1
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None and r["component_id"] is not None)
    plain = df.where("vec_id < 90")
    pairs = [(i, j) for i, a, g in usable for j, b, h in usable if i is not None and j is not None and max(i, j) < 90 and i != j and g == h and a.shape == b.shape and a @ b >= 0.98]
    root = {k: k for k in range(90)}
    for _ in range(90):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    for kind in ("array<double>", "array<float>"):
        got = vectors.near_duplicates(plain.dropDuplicates(["vec_id"]).withColumn("embedding", F.col("embedding").cast(kind)), tables=200, projections=6).collect()
        assert {r["vec_id"]: r["component_id"] for r in got} == root
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(df.where("vec_id = 101")).first()["component_id"] == 101


def test_plan_of_tables_grows_slowly():
    small, large = vectors.plan(10_000, 0.98), vectors.plan(1_000_000_000, 0.98)
    assert small[0] < large[0] < 9 * small[0] and small[1] < large[1] < 3 * small[1]
    assert vectors._meet(0.2, 0.8) == pytest.approx(0.8005, abs=1e-3)


def test_language(spark, docs, empty):
    rng = np.random.default_rng(4)
    syllables = {"xx": ["ka", "ti", "mo"], "yy": ["schu", "berg", "ein"]}
    rows = [(k, " ".join("".join(rng.choice(syllables[g], 3)) for _ in range(80)), g) for k, g in enumerate(["xx", "yy"] * 150)]
    rows += [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None), (1003, "½ ² ① Ⅷ", None), (1004, "_" * 900 + "ª", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1000, 1001, 1002, 1003))
    assert got[1004]["lang_pred"] in syllables
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [(k, g) for k, _, g in rows[:300] if got[k]["held_out"]]
    assert np.mean([got[k]["lang_pred"] == g for k, g in held]) > 0.95
    assert ids(langid.language_id(docs)) == ALL
    assert langid.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_byte_network_equals_a_plain_convolution():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (40, 32)).astype(np.uint8)
    net = langid.fit(rows, [["aa", "bb", "cc"][k % 3] for k in range(40)], epochs=2)
    got = net.probabilities(rows[:5], net.tables())
    for x, p in zip(rows[:5], got, strict=True):
        x, pooled = [*x.tolist(), 0, 0, 0], []
        for c, kernel in enumerate(net.kernels):
            for f in range(kernel.shape[2]):
                sums = [sum(float(net.embedding[x[i + j]] @ kernel[j, :, f]) for j in range(kernel.shape[0])) for i in range(32)]
                pooled.append(max(0.0, max(sums) + float(net.biases[c * langid.FILTERS + f])))
        z = np.array(pooled) @ net.dense + net.offset
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert p == pytest.approx(want, abs=1e-4)


def test_masks_tolerate_two_substitutions_anywhere():
    for a in range(13):
        for b in range(13):
            assert any(all(s + k not in (a, b) for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(13 - len(m) + 1))


def test_decontamination_by_brute_force(spark, docs, empty):
    rng = np.random.default_rng(8)
    items = [(k, text(50 + k, 20)) for k in range(6)] + [(6, None), (7, "short"), (None, text(60, 15)), (8, text(61, 9)), (9, text(62, 4)), (10, "!!"), (11, text(63, 12))]
    rows = []
    for k in range(60):
        w = text(200 + k, 60).split()
        _, t = items[k % 6]
        passage = t.split()
        for _ in range(rng.integers(0, 6)):
            passage[rng.integers(0, 20)] = "zzz"
        at = rng.integers(0, 60)
        rows.append((k, " ".join(w[:at] + passage[: rng.integers(10, 21)] + w[at:])))
    rows += [(None, text(60, 15)), (70, None), (71, ""), (72, "x " + text(61, 9) + " y"), (73, text(62, 4)), (74, "short"), (75, text(61, 8)), (76, text(63, 12)), (77, text(63, 11) + " other " + text(63, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, t in rows:
        for i, u in items:
            w, q = (t or "").split(), (u or "").split()
            span = min(13, len(q))
            need = span - (2 if len(q) >= 13 else 0)
            hits = [(x, sum(w[x + k] == q[y + k] for k in range(span))) for x in range(len(w) - span + 1) for y in range(len(q) - span + 1)] if q else []
            good = [(x, m) for x, m in hits if m >= need]
            if good:
                want[d, i] = (min(x for x, _ in good), max(x for x, _ in good), max(m for _, m in good))
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"], r["matched"]) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == want
    clean = decontaminate.decontaminate(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    assert decontaminate.overlaps(empty, bench).count() == 0


def test_toxicity_finds_telling_words_among_many_common_ones():
    rng = np.random.default_rng(3)
    bad = [f"bad{k}" for k in range(10)]

    def text(toxic):
        words = [f"w{k}" for k in rng.integers(0, 1000, 150)]
        return " ".join([*words, *rng.choice(bad, 2)] if toxic else words)

    labels = [int(k % 10 == 0) for k in range(3000)]
    docs = [toxicity.terms(text(y)) for y in labels]
    model = toxicity.fit(docs[:2000], labels[:2000])
    found = [model.margin(d) > 0 for d in docs[2000:]]
    assert sum(f for f, y in zip(found, labels[2000:], strict=True) if y) >= 90  # of 100
    assert sum(f for f, y in zip(found, labels[2000:], strict=True) if not y) <= 5
