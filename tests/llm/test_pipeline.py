"""The pipeline's stages against their operators, and the registered queries against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from leadloom.llm import queries


def test_stages_take_effect(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(300))
    other = " ".join(f"v{k}" for k in range(40))
    bench = " ".join(f"b{k}" for k in range(30))
    rows = [(0, long, "en"), (1, long, "en"), (2, other + " " + long, "en"), (3, "12345", "en"), (4, f"x {bench} y " + other.replace("v", "u"), "en"), (5, "clean words here", "en"), (6, None, None)]
    docs = spark.createDataFrame([(k, t, g, "s", len(t or "")) for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, frame = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name.replace(" ", "_"))
        stage(spark, frame, str(tmp_path)).write.parquet(out)
        frame = spark.read.parquet(out)
        assert frame.columns == docs.columns
        kept.append({r["doc_id"] for r in frame.collect()})
    assert kept == [{0, 1, 2, 4, 5}, {0, 2, 4, 5}, {0, 2, 4, 5}, {0, 2, 5}]
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert texts[0] == long and texts[5] == "clean words here" and texts[2].startswith("v0 v1") and len(texts[2]) < 200
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {0, 2, 5}


def test_near_dedup_goes_by_row(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, words("a"))] * 3 + [(None, words("b"))] * 2 + [(None, words("c")), (2, words("b")), (3, words("d")), (3, words("a")), (4, words("e")), (4, words("f"))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, "a"), (3, "d"), (4, "e"), (4, "f"), (None, "b"), (None, "c")]
    assert sorted(((r["doc_id"], r["text"][0]) for r in got.collect()), key=str) == want


def test_decontamination_goes_by_text(spark, tmp_path):
    bench = " ".join(f"b{k}" for k in range(30))
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, bench), (None, "clean one"), (None, None), (1, "x " + bench), (1, "clean two"), (2, bench), (3, "clean two")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == [(1, "clean two"), (3, "clean two"), (None, "clean one"), (None, None)]


def test_language_stage_fills_missing_labels(spark):
    rows = [(k, ("kati moka tiko " if k % 2 else "schubein bergein ein ") * 30, ["yy", "xx"][k % 2]) for k in range(200)]
    rows += [(500, "tiko kati moka " * 20, None), (501, "bergein schubein " * 20, None), (502, "½ ²", None)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert got == {k: ["yy", "xx"][k % 2] for k in range(200)} | {500: "xx", 501: "yy"}


KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, key long, kept int"


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows and columns with the operators' own names."""
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, None), (None, ""), (None, "some words"), (None, "some words"), (1, "other text here"), (1, "other text here"), (2, None), (3, "é" * 400)]
    docs = spark.createDataFrame([(k, t, None, None, None, 0.5, 7, 7, 1) for k, t in rows], KIND)
    texts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        texts.append(sorted((r["text"] for r in got.collect()), key=str))
    every = sorted((t for _, t in rows), key=str)
    assert texts[0] == sorted(t for t in every if t)
    assert texts[1] == sorted(["some words", "other text here", "é" * 400, None], key=str) and len(texts[2]) == len(rows)
    assert texts[2].count("some words") == 2 and texts[3] == every
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_language_stage_without_labels(spark):
    rows = [(0, "readable words", None), (1, "12 !", None), (2, None, None), (None, "more words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {0, None}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted([tuple(map(norm, r)) for r in df.select(*cols).collect()], key=str)
    assert got == sorted([tuple(map(norm, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()], key=str)
