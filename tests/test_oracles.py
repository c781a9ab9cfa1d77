"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from leadloom.plans import events, leads, machines, mappings, payloads, prospects, records, registers, texts

QUERIES = leads.QUERIES | prospects.QUERIES | texts.QUERIES | events.QUERIES | payloads.QUERIES | records.QUERIES | registers.QUERIES | machines.QUERIES | mappings.QUERIES
ORACLES = leads.ORACLES | prospects.ORACLES | texts.ORACLES | events.ORACLES | payloads.ORACLES | records.ORACLES | registers.ORACLES | machines.ORACLES | mappings.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted([tuple(map(_norm, r)) for r in df.select(*cols).collect()], key=str)
    want = sorted([tuple(map(_norm, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()], key=str)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
