"""Strict files against the standard library's reader, in splits, with every fault."""

import csv
import random

import pytest

from leadloom.sources.strict import read_strict


@pytest.mark.parametrize("delimiter", [",", "\t", "|"])
def test_quoted_breaks_are_read_in_splits(spark, tmp_path, delimiter):
    rng = random.Random(3)
    bits = ["a", '"', '""', "\n", "\r\n", delimiter, "é", " ", "x y", ""]
    rows = [[str(k), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), rng.choice(["end", "", "two\nlines"])] for k in range(800)]
    with open(tmp_path / "r.csv", "w", newline="", encoding="utf-8") as f:
        f.write('﻿Made "today\nby nobody\n')
        w = csv.writer(f, delimiter=delimiter, lineterminator="\n")
        w.writerow(["id", " Note", "extra", "tail"])
        for r in rows:
            w.writerow([r[0], r[1], "e", r[2]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = read_strict(spark, f"file://{tmp_path}/r.csv", ["tail", "ID", "note"], delimiter, banner_lines=2).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["ID"], r["note"], r["tail"], r["_fault"]) for r in got) == sorted((*r, None) for r in rows)


def test_every_fault_is_named(spark, tmp_path):
    lines = ["id,name", '1,"ok ""x"""', '2,"closed"late', '3,ba"r"e', "4", "5,a,b", "", "6," + "z" * 1_048_577, "7" + ",c" * 600, '8,"two\nlines"', '9,"open', "10,rest"]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    (tmp_path / "g.csv").write_text("name,more,id\r\nfine,x,20\r\n")
    rows = read_strict(spark, f"file://{tmp_path}/*.csv", ["id", "name"]).collect()
    assert {(r["id"], r["name"]) for r in rows if r["_fault"] is None} == {("1", 'ok "x"'), ("8", "two\nlines"), ("20", "fine")}
    faults = sorted(r["_fault"] for r in rows if r["_fault"])
    assert faults == sorted(["text_after_quote", "quote_in_bare_field", "short_row", "long_row", "field_too_large", "too_many_columns", "unclosed_quote", "unclosed_quote"])
    with pytest.raises(ValueError, match="lacks the columns"):
        read_strict(spark, f"file://{tmp_path}/*.csv", ["more"])
