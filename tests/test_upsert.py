"""Merges, audit rows and canonical documents."""

from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.sources.upsert import UpsertTable
from leadloom.streaming import audit

KIND = "id long, name string, n int"


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_merges(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    t = UpsertTable(spark, f"file://{tmp_path}/t", schema, "id", 4)
    assert rows(t) == [] and t.merge(spark.createDataFrame([], KIND)).created == 0
    first = spark.createDataFrame([(k, f"n{k}", k) for k in range(9)] + [(None, "x", 1), (None, "x", 1)], KIND)
    assert t.merge(first, writer="w", batch_id=0).created == 11
    second = spark.createDataFrame([(1, "new", None), (2, " ", 5), (3, "n3", None), (20, None, 1), (21, "a", 1), (21, "b", 0)], KIND)
    done = t.merge(second, order="n", writer="w", batch_id=1)
    assert (done.created, done.updated, done.unchanged, done.ambiguous) == (2, 2, 1, 0)
    want = [(k, f"n{k}", k) for k in range(9)] + [(None, "x", 1)] * 2
    want[1], want[2] = (1, "new", 1), (2, "n2", 5)
    assert rows(t) == sorted(want + [(20, None, 1), (21, "a", 1)], key=str)
    before = t.current().number
    assert t.merge(second, writer="w", batch_id=1).replayed and t.merge(first, writer="w", batch_id=0).replayed and t.current().number == before
    assert not t.merge(second, order="n", writer="other", batch_id=0).replayed


def test_ambiguous_keys_are_left_alone(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    t = UpsertTable(spark, f"file://{tmp_path}/t", schema, "id", 2)
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], KIND))
    v = t.current()
    twin = f"file://{tmp_path}/twin"
    spark.createDataFrame([(1, "a", 1), (1, "c", 3), (2, "b", 2)], KIND).write.parquet(twin)
    v.number, v.buckets = v.number + 1, {k: twin for k in v.buckets}
    assert t._commit(v)
    done = t.merge(spark.createDataFrame([(1, "z", 9)], KIND))
    assert (done.ambiguous, done.updated, done.created) == (1, 0, 0)
    assert [r for r in rows(t) if r[0] == 1][:2] == [(1, "a", 1), (1, "c", 3)]


def test_a_merge_that_comes_second_is_planned_anew(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    a, b = (UpsertTable(spark, f"file://{tmp_path}/t", schema, "id", 2) for _ in range(2))
    commit, raced = a._commit, []

    def late(version):
        if not raced:
            raced.append(b.merge(spark.createDataFrame([(1, "theirs", None), (2, "same", 2)], KIND)))
        return commit(version)

    a._commit = late
    done = a.merge(spark.createDataFrame([(1, None, 7), (2, "same", 2), (3, "mine", 3)], KIND))
    assert raced[0].created == 2 and (done.created, done.updated, done.unchanged, done.replanned) == (1, 1, 1, 1)
    assert rows(a) == [(1, "theirs", 7), (2, "same", 2), (3, "mine", 3)]


def test_streams_merge_each_batch_once_and_leave_audit_rows(spark, tmp_path):
    schema = spark.createDataFrame([], KIND).schema
    for k in range(3):
        spark.createDataFrame([(k, f"v{k}", k), (7, f"v{k}", k)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = UpsertTable(spark, f"file://{tmp_path}/t", schema, "id", 2)
    sink, calls = table.sink("n"), []

    def twice(df, batch_id):
        calls.append(batch_id)
        sink(df, batch_id)
        sink(df, batch_id)  # as after a failure between the merge and Spark's own commit

    listener = audit.AuditListener()
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        counted = source.observe(audit.NAME, *audit.outcome_counters("name", ["v0", "v1"]))
        q = counted.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and len(calls) == 3
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert [r for r in rows(table) if r[0] != 7] == [(k, f"v{k}", k) for k in range(3)]
    assert len([r for r in rows(table) if r[0] == 7]) == 1 and table.current().number == 3
    totals = listener.rows(spark).select(F.explode("metrics").alias("c", "n")).groupBy("c").sum("n").collect()
    assert {r[0]: r[1] for r in totals} == {"rows": 6, "v0": 2, "v1": 2, "other": 2}


def test_audit_row_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "o string")
    row = audit.audited_write(df, f"file://{tmp_path}/out", "r1", *audit.outcome_counters("o", ["a", "c"])).first()
    assert row["metrics"] == {"rows": 4, "a": 2, "c": 0, "other": 2} and spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_canonical_documents(spark):
    texts = ['{"b":{"sha256":"q\\"}","a":[{"y":2,"x":null}]},"a":1.50,"sha256":"q"}', '{"a":1.5,"b":{"a":[{"x":null,"y":2}]}}', '{"a":1.5,"b":{"a":[{"x":null,"y":3}]}}', '{"sha256":1}', "{}", "no", None, '{"t":"say \\"sha256\\":\\"x\\", ok"}']
    got = [r["h"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", keys.document_hash(F.col("t")).alias("h")).orderBy("k").collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4] and got[5] is None and got[6] is None
    import hashlib

    assert got[7] == "sha256:" + hashlib.sha256(texts[7].encode()).hexdigest()
