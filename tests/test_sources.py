import json
import zipfile

import pytest

from leadloom.sources import archives, delimited, sealed
from leadloom.sources.paged import FeatureService


def test_csv_keeps_quotes_breaks_and_reports_ragged_rows(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text('id,name,note\n1,"A ""B"", Inc","two\nlines"\n2,short\n3,C,ok\n')
    df = delimited.read_register(spark, str(f), ["id", "name", "note"])
    got = {r["id"]: r for r in df.collect()}
    assert got["1"]["name"] == 'A "B", Inc' and got["1"]["note"] == "two\nlines"
    assert got["2"]["_corrupt"] is not None and got["3"]["_corrupt"] is None


def test_tsv_and_banner(spark, tmp_path):
    t = tmp_path / "r.tsv"
    t.write_text("id\tname\n1\tA, B\n")
    assert delimited.read_register(spark, str(t), ["id", "name"], "\t").first()["name"] == "A, B"
    b = tmp_path / "b.csv"
    b.write_text('﻿Generated today\nid, name\n1,"x"\n\n2,y\n')
    assert [r["name"] for r in delimited.read_register(spark, str(b), ["id", " name"], banner_lines=1).collect()] == ["x", "y"]


def test_contracts():
    assert delimited.header_gap(["ID", " Name", "lat"], ["id", "name", "zip"]) == (["zip"], ["lat"])


def test_closed_and_forbidden(spark):
    df = spark.sql("SELECT 1 AS Id, 2 AS Lat, named_struct('owner', 'x', 'in', array(named_struct('lng', 1))) AS n")
    assert delimited.closed(df, ["id"]).columns == ["Id"]
    assert delimited.forbidden_paths(df.schema, {"lat", "lng", "owner"}) == ["Lat", "n.owner", "n.in.lng"]


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q'), ("", "x")], "x string, y string")
    delimited.export_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"')
    assert {(r["x"] or "", r["y"]) for r in back.collect()} == {("a,b", 'q"q'), ("", "x")}


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("r.csv", "﻿id,name\n1,x\n")
        z.writestr("readme.txt", "no")
    assert [r["line"] for r in archives.read_zip_lines(spark, str(tmp_path / "a.zip")).orderBy("n").collect()] == ["id,name", "1,x"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a.csv", "1")
        z.writestr("b.csv", "2")
    with pytest.raises(ValueError, match="2 entries"):
        list(archives.entry_lines((tmp_path / "b.zip").read_bytes(), ".csv"))


def test_paged_service(spark, tmp_path):
    for k, ids in ((0, [1, 2]), (2, [3])):
        (tmp_path / f"{k}.json").write_text(json.dumps({"features": [{"attributes": {"PROPERTY_ID": i, "NAME": f"n{i}", "SECRET": 1}} for i in ids]}))
    spark.dataSource.register(FeatureService)
    df = spark.read.format("features").schema("PROPERTY_ID string, NAME string").options(url=f"file://{tmp_path}", pagesize="2", maxpages="3").load()
    assert sorted(r["NAME"] for r in df.collect()) == ["n1", "n2", "n3"]


def test_sealed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, name string")
    p = str(tmp_path / "s")
    sealed.write_sealed(df, p, "county", "2024-01-31 10:00:00")
    assert sealed.check_sealed(spark, p, "county", "2024-01-31 12:00:00").first()["problems"] == []
    assert sealed.check_sealed(spark, p, "city", "2024-02-02 12:00:00").first()["problems"] == ["source", "age"]
    rows = spark.read.parquet(f"{p}/rows").collect()
    spark.createDataFrame([r if r["id"] == 1 else (3, "forged", r["row_hash"]) for r in rows], "id int, name string, row_hash string").write.mode("overwrite").parquet(f"{p}/rows")
    assert "seal" in sealed.check_sealed(spark, p, "county", "2024-01-31 12:00:00").first()["problems"]


def test_register_columns_go_by_name(spark, tmp_path):
    import pytest

    from leadloom.sources.delimited import read_register

    path = tmp_path / "swapped.csv"
    path.write_text('B,a,more\n1,2,x\n"3\n4",5,y\n')
    assert [(r["a"], r["b"]) for r in read_register(spark, str(path), ["a", "b"]).collect()] == [("2", "1"), ("5", "3\n4")]
    with pytest.raises(ValueError):
        read_register(spark, str(path), ["a", "c"])


def test_pages_never_end_silently(tmp_path):
    import json

    import pytest
    from pyspark.sql import types as T

    from leadloom.sources.paged import FeatureReader

    kind = T.StructType([T.StructField("k", T.StringType())])
    (tmp_path / "0.json").write_text(json.dumps({"features": [{"attributes": {"k": 1}}, {"attributes": {"k": 2}}], "exceededTransferLimit": True}))
    (tmp_path / "2.json").write_text(json.dumps({"features": [{"attributes": {"k": 3}}]}))
    pages = lambda n, size: [list(r.read(p)) for r in [FeatureReader(kind, {"url": f"file://{tmp_path}", "pagesize": size, "maxpages": n})] for p in r.partitions()]
    assert pages(3, 2) == [[("1",), ("2",)], [("3",)], []]
    for n, size in ((1, 2), (3, 4)):
        with pytest.raises(ValueError):
            pages(n, size)


def test_blank_proposals_change_nothing(spark):
    from leadloom.operators import resolve

    old = spark.createDataFrame([(1, "a", 5)], "id int, t string, n int")
    new = spark.createDataFrame([(1, " ", None), (2, "b", 3)], "id int, t string, n int")
    assert sorted(map(tuple, resolve.apply_plan(old, new, "id", ["t", "n"]).collect())) == [(1, "a", 5), (2, "b", 3)]
