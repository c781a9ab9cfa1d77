from pyspark.sql import functions as F

from leadloom.operators import sequential, temporal
from leadloom.streaming import stateful


def _stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_rate_limit_stream_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = _stream(spark, sf_dir, tmp_path)
    want = sequential.anchored(batch, "user_id", "ts", "event_id", 3, 86_400)
    got = _run(stateful.rate_limited(stream, 3, 86_400), tmp_path, "limited")
    assert {tuple(r) for r in got.select("event_id", "allowed").collect()} == {tuple(r) for r in want.select("event_id", "allowed").collect()}


def test_tumbling_stream_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = _stream(spark, sf_dir, tmp_path)
    want = {(r["window"]["start"], r["event_type"], r["n"]) for r in temporal.tumbling(batch, "6 hours", "event_type").collect()}
    got = {(r["window"]["start"], r["event_type"], r["n"]) for r in _run(stateful.tumbling_counts(stream, "6 hours", "1 hour"), tmp_path, "tumbled", "complete").collect()}
    assert got == want


def test_stream_join_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = _stream(spark, sf_dir, tmp_path)
    got = _run(stateful.touches(stream.where("event_type = 'view'"), stream.where("event_type = 'click'"), "6 hours", "40 days"), tmp_path, "touched")
    e = batch.selectExpr("event_id AS id", "user_id", "ts", "event_type")
    want = temporal.interval_join(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", 21_600)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
