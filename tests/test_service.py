"""The tabular service's source against a scripted service over orders, and the delivery sink."""

import datetime as dt
import email.utils
import http.server
import json
import re
import sqlite3
import threading
import urllib.parse

import pyarrow.parquet as pq
import pytest

from leadloom.sources.delivery import Delivery
from leadloom.sources.service import Retry, TabularService, Throttled, asked_wait, condition, literal

SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@pytest.fixture(scope="module")
def service(sf_dir):
    """Answers queries over orders; `state.refuse` requests are first answered by 429."""
    rows = pq.read_table(f"{sf_dir}/orders.parquet").to_pylist()
    names = list(rows[0])
    db = sqlite3.connect(":memory:", check_same_thread=False)
    db.create_function("starts_with", 2, lambda a, b: None if a is None else a.startswith(b))
    db.execute(f"CREATE TABLE t ({', '.join(names)})")
    rows[3]["o_orderpriority"] = "1-O'HARA"
    rows[4]["o_orderpriority"] = None
    db.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(names))})", [tuple(v.isoformat() if isinstance(v, dt.datetime) else v for v in r.values()) for r in rows])
    lock, state = threading.Lock(), type("S", (), {"asked": [], "refuse": 0, "header": "0"})()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k[1:]: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            with lock:
                if state.refuse:
                    state.refuse -= 1
                    self.send_response(429)
                    self.send_header("Retry-After", state.header)
                    self.end_headers()
                    return
                state.asked.append(q)
                sql = f"SELECT {q['select']} FROM t" + "".join(f" {w} {q[k]}" for k, w in (("where", "WHERE"), ("order", "ORDER BY"), ("limit", "LIMIT")) if k in q)
                cursor = db.execute(sql)
                names = [re.split(" AS ", c[0])[-1] for c in cursor.description]
                body = json.dumps([dict(zip(names, r, strict=True)) for r in cursor.fetchall()]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state.url, state.rows = f"http://127.0.0.1:{server.server_port}/orders", rows
    yield state
    server.shutdown()


def load(spark, service, schema=SCHEMA, push=True, **options):
    spark.dataSource.register(TabularService)
    service.asked.clear()
    return spark.read.format("service").schema(schema).options(url=service.url, key="o_orderkey", push=push, **options).load()


def test_all_rows_by_key_ranges_and_pages(spark, service):
    df = load(spark, service, pagesize=100, numpartitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r["o_orderkey"], r["o_totalprice"], r["o_orderpriority"], r["o_orderdate"]) for r in df.collect()) == sorted((r["o_orderkey"], r["o_totalprice"], r["o_orderpriority"], r["o_orderdate"]) for r in service.rows)
    pages = [q for q in service.asked if "limit" in q]
    assert len(pages) >= len(service.rows) / 100 and all(q["order"] == "o_orderkey" for q in pages)


FILTERS = [
    "o_orderpriority = '1-O''HARA'",
    "o_orderpriority IN ('1-O''HARA', '2-HIGH') AND o_totalprice > 1000.5",
    "o_orderpriority IS NULL",
    "o_orderpriority LIKE '1-%' AND o_orderkey <= 900",
    "o_orderstatus <> 'F' AND o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'",
    "o_orderpriority LIKE '%HARA' OR length(o_orderstatus) > 3",
]


@pytest.mark.parametrize("where", FILTERS)
def test_pushed_filters_give_the_rows_of_an_unpushed_scan(spark, service, where):
    want = sorted(r["o_orderkey"] for r in load(spark, service, push=False).where(where).collect())
    assert all("OR" not in q.get("where", "") and "'" not in q.get("where", "") for q in service.asked)
    df = load(spark, service).where(where)
    assert sorted(r["o_orderkey"] for r in df.collect()) == want
    if " OR " not in where:
        assert want and any("o_order" in re.sub(r"o_orderkey (>|<=) \d+", "", q.get("where", "")) for q in service.asked)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Filter " not in plan or "LIKE" in where, plan


def test_only_the_schemas_fields_are_asked_for(spark, service):
    load(spark, service, "o_orderkey long, o_custkey long").collect()
    assert {q["select"] for q in service.asked if "limit" in q} == {"o_orderkey, o_custkey"}


def test_an_incomplete_scan_says_so(spark, service):
    with pytest.raises(Exception, match="raise maxpages"):
        load(spark, service, pagesize=10, maxpages=2, numpartitions=3).collect()
    got = load(spark, service, "o_orderkey long, _complete boolean", pagesize=10, maxpages=2, numpartitions=3).collect()
    assert len(got) == 60 and sum(not r["_complete"] for r in got) == 3
    whole = load(spark, service, "o_orderkey long, _complete boolean", pagesize=100).collect()
    assert len(whole) == len(service.rows) and all(r["_complete"] for r in whole)


def test_text_keys_are_cut_where_the_caller_says(spark, service):
    df = load(spark, service, splits=json.dumps([500, 900]), pagesize=50)
    assert df.rdd.getNumPartitions() == 3 and df.count() == len(service.rows)


def test_refused_requests_are_repeated(spark, service):
    service.refuse = 3
    assert load(spark, service, pagesize=500).count() == len(service.rows)
    service.refuse, service.header = 3, "nonsense"
    assert load(spark, service, pagesize=500, basewait="0.01").count() == len(service.rows)
    service.refuse, service.header = 40, "0"
    with pytest.raises(Exception, match="after 4 attempts"):
        load(spark, service).count()
    service.refuse = 0


def test_waits():
    now = 1_700_000_000.0
    assert asked_wait("120", now) == 120 and asked_wait("1.5", now) == 1.5
    assert asked_wait(email.utils.formatdate(now + 90, usegmt=True), now) == 90
    assert asked_wait(email.utils.formatdate(now - 90, usegmt=True), now) == 0
    assert [asked_wait(x, now) for x in (None, "", "-5", "soon", "Wed, nonsense")] == [None] * 5


class Answer(Exception):
    pass


def test_back_off_is_jittered_bounded_and_within_the_budget():
    import io
    import urllib.error

    def refused(header=None):
        def opener(url, timeout):
            raise urllib.error.HTTPError(url, 429, "", {"Retry-After": header} if header else {}, io.BytesIO())

        return opener

    waits = []
    with pytest.raises(Throttled, match="after 6 attempts"):
        Retry(6, 1.0, 5.0, sleep=waits.append, draw=lambda: 0.5).get("http://x", opener=refused())
    assert waits == [0.5, 1.0, 2.0, 2.5, 2.5]
    waits.clear()
    with pytest.raises(Throttled, match="after 4 attempts"):
        Retry(sleep=waits.append, budget=10_000).get("http://x", opener=refused("4000"))
    assert waits == [300.0] * 3
    waits.clear()
    with pytest.raises(Throttled, match="after 1 attempts"):
        Retry(sleep=waits.append, budget=60).get("http://x", opener=refused("120"))
    assert waits == []


def test_literals():
    assert literal("O'Hara''s") == "'O''Hara''''s'" and literal(True) == "true" and literal(dt.date(2024, 1, 2)) == "'2024-01-02'"
    from pyspark.sql.datasource import EqualTo, In

    assert condition(EqualTo(("a",), "x'; --")) == "a = 'x''; --'"
    assert condition(EqualTo(("a b",), 1)) is None and condition(In(("a",), (1, None))) is None


# ---- delivery


def test_a_delivery_is_all_or_nothing_and_repeatable(spark, tmp_path):
    spark.dataSource.register(Delivery)
    df = spark.range(50).selectExpr("id", "named_struct('a', concat('x', id), 'b', array(id)) AS body").repartition(4)
    save = lambda d, run: d.write.format("delivery").mode("append").options(path=f"file://{tmp_path}/out", run=run).save()
    save(df, "r1")
    save(df, "r1")
    back = spark.read.json(f"{tmp_path}/out/r1/*.jsonl")
    assert back.count() == 50 and back.select("body.a").distinct().count() == 50
    assert json.loads((tmp_path / "out/r1/_MANIFEST.json").read_text()) == {"run": "r1", "files": 4, "rows": 50}
    with pytest.raises(Exception):  # noqa: B017
        save(df.selectExpr("id", "if(id = 37, raise_error('no'), body) AS body"), "r2")
    assert not (tmp_path / "out/r2").exists() and not list((tmp_path / "out/_pending").glob("*"))
    save(df.limit(0), "r3")
    assert json.loads((tmp_path / "out/r3/_MANIFEST.json").read_text())["rows"] == 0
