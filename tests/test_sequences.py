"""Anchored windows and quotas without a per-row loop, scheduled mail over ticks, inserts and plans on odd keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from leadloom.operators import drip, ordered, resolve, sequential
from leadloom.streaming import drip as stream_drip

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BIG = 9007199254740993


def hits(seed, n):
    rng = random.Random(seed)
    keys = [None, BIG, BIG + 1, 7, 8]
    out = []
    for k in range(n):
        key = 1 if rng.random() < 0.4 else rng.choice(keys)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 20_000, 30))
        out.append((k, key, None if k % 61 == 0 else ts, None if k % 53 == 0 else rng.random() < 0.5))
    return out


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or dt.datetime.min, r[0])


def brute_anchored(rows, limit, seconds):
    out, last, start, count = {}, object(), None, 0
    for i, key, ts, _ in sorted(rows, key=order):
        if key != last or (ts and (start is None or (ts - start).total_seconds() > seconds)):
            last, start, count = key, ts, 0
        count += 1
        out[i] = count <= limit
    return out


def test_anchored_windows_equal_a_walk(spark):
    rows = hits(1, 1500)
    df = spark.createDataFrame(rows, "id long, key long, ts timestamp, f boolean").repartition(7)
    for limit, seconds, small in ((2, 86_400, 300), (1, 1800, 0), (3, 0, 5000), (5, 10**7, 250)):
        got = sequential.anchored(df, "key", "ts", "id", limit, seconds, small)
        assert {r["id"]: r["allowed"] for r in got.collect()} == brute_anchored(rows, limit, seconds)
    assert {(r["id"], r["key"]) for r in got.collect()} == {(r[0], r[1]) for r in rows}
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_six_null_keys_share_a_window(spark):
    df = spark.createDataFrame([(k, None, dt.datetime(2024, 1, 1, 0, k)) for k in range(6)], "id int, key long, ts timestamp")
    for small in (0, 512):
        got = {r["id"]: r["allowed"] for r in sequential.anchored(df, "key", "ts", "id", 2, 3600, small).collect()}
        assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}
    assert sequential.anchored(df.limit(0), "key", "ts", "id", 2, 3600).isEmpty()


def test_quotas_equal_a_walk(spark):
    rows = hits(2, 1500)
    df = spark.createDataFrame(rows, "id long, key long, ts timestamp, f boolean").repartition(5)
    for seconds, small in ((86_400, 300), (1800, 0), (86_400, 5000)):
        want, last, held = {}, object(), None
        for i, key, ts, f in sorted(rows, key=order):
            if key != last:
                last, held = key, None
            want[i] = held is None or ts is None or (ts - held).total_seconds() >= seconds
            if want[i] and f and ts:
                held = ts
        got = sequential.elapsed(df, "key", "ts", "id", seconds, "f", small)
        assert {r["id"]: r["allowed"] for r in got.collect()} == want


def test_a_hot_key_spans_ranges(spark):
    df = spark.range(4000).selectExpr("id", "1 AS key", "timestamp_seconds(id * 60) AS ts")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else ranges as small as these are put together
    try:
        rows = ordered.ranged(df, "key", "ts", "id")
    finally:
        spark.conf.unset(key)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2500
    placed = ordered.numbered(df, "key", "ts", "id")
    assert placed.where("position <> id").isEmpty()


def test_remainder_of_a_cap(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(40)], "id int, score int").withColumn("down", -F.col("score"))
    out = ordered.with_remainder(df, 10, "down", "id").groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in out} == {"kept": 10, "over_cap": 30}
    assert ordered.with_remainder(df.limit(0), 10, "down", "id").isEmpty()


def test_inserts_and_plans_on_odd_keys(spark):
    kind = "k int, v string"
    old = spark.createDataFrame([(1, "a"), (None, "n")], kind)
    new = spark.createDataFrame([(1, "b"), (2, "z"), (2, "c"), (None, "p"), (None, "q")], kind).repartition(4)
    assert sorted(map(tuple, resolve.insert_ignore(old, new, ["k"], "v").collect()), key=str) == sorted([(1, "a"), (None, "n"), (2, "c"), (None, "p"), (None, "q")], key=str)
    twins = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], kind)
    want = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "p"), (4, "q")], kind)
    assert sorted(map(tuple, resolve.apply_plan(twins, want, "k", ["v"]).collect()), key=str) == sorted([(1, "a"), (1, "b"), (2, "y"), (3, "z"), (None, "n")], key=str)


# ---- scheduled mail


def test_a_tick_takes_the_first_due_steps_only(spark):
    kind = "id long, sequence string, step string, position int, scheduled_at timestamp_ntz, status string, error string, unsubscribed boolean, lead_status string"
    t = dt.datetime(2024, 5, 1, 12)
    rows = [(k, "commercial", "quote", 0, t - dt.timedelta(minutes=k % 3), "pending", None, False, "new") for k in range(9)]
    out = drip.tick(spark.createDataFrame(rows, kind), "2024-05-01 18:00:00", F.lit(None).cast("string"), F.lit(None).cast("string"), limit=4)
    assert {r["id"] for r in out.where("outcome = 'sent'").collect()} == {2, 5, 8, 1}
    again = drip.tick(out, "2024-05-01 18:00:00", F.lit(None).cast("string"), F.lit(None).cast("string"), limit=4)
    assert again.where("status = 'sent'").count() == 8


def rules():
    """What stops a mail, and what its delivery answers: local functions, which are sent to the workers as they are."""

    def refusal(lead, sequence, step, position, now):
        return "daily_limit_reached" if (lead + now // 21_600_000) % 7 == 0 else "no_mx" if lead % 11 == 2 else None

    def mail_error(lead, sequence, step, position, now):
        return "full" if (lead + position) % 10 == 0 else "slow" if (lead + position + now // 1_800_000) % 5 == 1 else None

    return refusal, mail_error


def test_the_stream_and_the_ticks_agree(spark, tmp_path):
    refusal, mail_error = rules()
    every, begin = 30, dt.datetime(2024, 5, 1, 1, 10)
    leads = [(k, None, "outbound" if k % 4 == 0 else "form", "commercial" if k % 2 else "residential", begin + dt.timedelta(minutes=7 * k), k % 9 == 5, "won" if k % 8 == 3 else "new") for k in range(24)]
    kind = "id long, sequence string, contact_channel string, segment string, created_at timestamp_ntz, unsubscribed boolean, lead_status string"
    facts = spark.createDataFrame(leads, kind)
    steps = drip.enrolled(None, facts, F.col("created_at"))
    ticks = [dt.datetime(2024, 5, 1, 1, 30) + dt.timedelta(minutes=every * k) for k in range(48)]

    # The batch side: one table after the other.
    by = {(r["id"], r["sequence"], r["step"]): r for r in steps.collect()}
    table, outcomes = steps.join(facts.select("id", "unsubscribed", "lead_status"), "id"), []
    schema = table.schema
    rows = table.collect()
    for now in ticks:
        millis = int(now.replace(tzinfo=dt.UTC).timestamp() * 1000)
        due = [r for r in rows if r["status"] == "pending" and r["scheduled_at"] <= now]
        if not due:
            continue
        python = [(r["id"], r["sequence"], r["step"], refusal(r["id"], None, None, r["position"], millis), mail_error(r["id"], None, None, r["position"], millis)) for r in due]
        asked = spark.createDataFrame(python, "id long, sequence string, step string, refusal string, answer string")
        touched = {r["id"] for r in due}
        some = spark.createDataFrame([r for r in rows if r["id"] in touched], schema).join(asked, ["id", "sequence", "step"], "left")
        after = drip.tick(some, str(now), F.col("refusal"), F.col("answer")).drop("refusal", "answer").collect()
        outcomes += [(r["id"], r["sequence"], r["step"], now, r["outcome"]) for r in after if r["outcome"]]
        rows = [r for r in rows if r["id"] not in touched] + [r.asDict() for r in after]
        rows = [{c: r[c] for c in schema.names} for r in rows]
    want = {(r["id"], r["sequence"], r["step"]): (r["status"], r["error"]) for r in rows if r["status"] != "pending"}
    assert len(by) == len(rows) and len({v[0] for v in want.values()}) == 3

    # The stream: enrolments and facts, then rows that only move time on.
    kind = "id long, kind string, ts timestamp_ntz, sequence string, step string, position int, scheduled_at timestamp_ntz, unsubscribed boolean, lead_status string"
    first = [(i, "step", begin, s, st, r["position"], r["scheduled_at"], None, None) for (i, s, st), r in by.items()]
    first += first[:10]  # a second enrolment adds none
    first += [(r[0], "fact", begin, None, None, None, None, r[5], r[6]) for r in leads]
    spark.createDataFrame(first, kind).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    late = dt.datetime(2024, 9, 1)
    for k, at in enumerate([ticks[-1], late, late + dt.timedelta(days=1)], 1):
        spark.createDataFrame([(-1, "fact", at, None, None, None, None, False, None)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        machine = stream_drip.DripMachine(refusal, mail_error, every, keep=24 * 60)
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = stream_drip.drip(source, machine).writeStream.format("memory").queryName("drip_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        out = [r for r in spark.table("drip_out").collect() if r["at"] <= ticks[-1]]
        assert sorted((r["id"], r["sequence"], r["step"], r["at"], r["outcome"]) for r in out if r["outcome"]) == sorted(outcomes)
        last = {}
        for r in sorted(out, key=lambda r: r["at"]):
            last[r["id"], r["sequence"], r["step"]] = (r["status"], r["error"])
        assert {k: v for k, v in last.items() if v[0] != "pending"} == want
        state = spark.read.format("statestore").option("stateVarName", "steps").load(f"{tmp_path}/ck")
        assert state.isEmpty()  # all steps have ended and their leads' time is over
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_recent_contacts_equal_a_count(spark):
    from leadloom.operators import guards

    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), None if k % 50 == 7 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.choice([0, 24, 72, rng.randrange(600)]), seconds=rng.choice([0, 0, 1]))) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, domain string, ts timestamp_ntz").repartition(3)
    got = guards.recently_contacted(df, 3)
    assert got.columns == ["id", "domain", "ts", "recent"]
    for r in got.collect():
        want = 0 if r["ts"] is None else sum(d == r["domain"] and t is not None and r["ts"] - dt.timedelta(days=3) <= t < r["ts"] for _, d, t in rows)
        assert r["recent"] == want, r


def test_first_rows_of_keys_in_a_stream(spark, tmp_path):
    from leadloom.streaming import stateful

    kind = "k int, event_id int, ts timestamp_ntz"
    t = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, 1, t), (2, 2, t)], [(1, 3, t + dt.timedelta(minutes=1)), (3, 4, t)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stateful.first_seen(source, ["k"], "1 hour").writeStream.format("memory").queryName("first_rows").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["k"], r["event_id"]) for r in spark.table("first_rows").collect()} == {(1, 1), (2, 2), (3, 4)}
