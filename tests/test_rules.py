"""Golden values, metamorphic relations, edge cases of the rules and prices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.functions import contact, crypto, keys, money, text
from leadloom.operators import guards, pricing, resolve, segments, sequential, web
from leadloom.plans import chain, events, prospects
from leadloom.sources import synthetic


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_segment_prices_are_the_known_ones(spark):
    got = {r["segment"]: (r["visit_value"], r["quote_low"], r["quote_high"], r["annual_value"]) for r in prospects.priced_segments(spark).collect()}
    assert got == {
        "property_manager": (245, 215, 275, 12730),
        "office_clinic": (395, 350, 440, 20524),
        "restaurant_retail": (295, 260, 330, 76818),
        "str_host": (140, 125, 155, 7274),
        "post_construction": (650, 570, 730, 0),
    }


def quote(spark, **job):
    base = {"segment": "residential", "service_type": "standard", "frequency": "one_time", "bedrooms": "2", "bathrooms": "1", "sqft": "2000", "addons": []} | job
    df = spark.createDataFrame([base], "segment string, service_type string, frequency string, bedrooms string, bathrooms string, sqft string, addons array<string>")
    return pricing.with_quote(df).first()


def test_prices_move_as_they_should(spark):
    assert quote(spark, bedrooms="4")["quote_price"] > quote(spark)["quote_price"]
    assert quote(spark, service_type="deep")["quote_price"] > quote(spark)["quote_price"]
    assert quote(spark, frequency="weekly")["quote_price"] <= quote(spark)["quote_price"]
    assert quote(spark)["annual_value"] == 0 and quote(spark, frequency="weekly")["annual_value"] > 0
    q = quote(spark)
    assert q["quote_low"] < q["quote_price"] < q["quote_high"]
    assert quote(spark, addons=["oven", "oven", "nothing"])["quote_price"] == quote(spark, addons=["oven"])["quote_price"]


@pytest.mark.parametrize("bad", [None, "", "many", "-3", "12abc"])
def test_malformed_rooms_still_have_a_price(spark, bad):
    assert quote(spark, bedrooms=bad, bathrooms=bad, addons=None)["quote_price"] >= 130


def test_chain_stops_at_the_first_rule(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "ok")], "id int, v string")
    rules = [("missing", "no value", F.col("v").isNull()), ("bad", "x", F.col("v") == "x"), ("never", "all", F.col("v") == "x")]
    got = {r["id"]: r["kind"] for r in chain.verdict(df, rules).collect()}
    assert got == {1: "bad", 2: "missing", 3: None}


def test_segments_and_confidence(spark):
    rows = [("Clínica Dental", "621210", None), ("Nothing", "", "permit_finaled"), (None, None, None), ("Bar", "5312", None)]
    df = spark.createDataFrame(rows, "name string, code string, kind string").coalesce(1)
    got = [(r["segment"], r["confidence"], r["matched"]) for r in segments.with_segment(df, F.col("name"), F.col("code"), F.col("kind")).collect()]
    assert got == [
        ("office_clinic", 1.0, ["dental", "clinic", "clinica", "naics:621210"]),
        ("post_construction", 0.9, ["permit_finaled"]),
        (None, 0.0, []),
        ("property_manager", 0.2, ["naics~5312"]),
    ]


def test_inbound_opt_out_outranks_a_price_question(spark):
    f = segments.inbound_category
    assert one(spark, f(F.lit("How much? Please unsubscribe me"))) == "opt_out"
    assert one(spark, f(F.lit("how much is a visit"))) == "quote_request"
    assert one(spark, f(F.lit("requotes"))) == "unrelated"
    assert one(spark, f(F.lit(None).cast("string"))) == "unrelated"


def test_contacts(spark):
    assert one(spark, contact.phone(F.lit("(619) 555-0101"))) == "+16195550101"
    assert one(spark, contact.phone(F.lit(None))) == ""
    assert one(spark, contact.email_status(F.lit(" A@mailinator.com "))) == "disposable"
    assert one(spark, contact.email_status(F.lit("nope"))) == "invalid"
    assert one(spark, contact.valid_date(F.lit("2024-02-30"))) is None
    assert one(spark, contact.valid_date(F.lit("2024-02-29"))) == dt.date(2024, 2, 29)
    page = '<a href="mailto:Owner@shop.com">x</a> info@other.com hero@2x.png help@shop.com'
    assert one(spark, contact.ranked_emails(F.lit(page), F.lit("www.shop.com"))) == ["owner@shop.com", "help@shop.com", "info@other.com"]
    assert one(spark, contact.page_phone(F.lit("<b>Call</b> 619.555.0199"))) == "+16195550199"


def test_keys(spark):
    k = keys.dedupe_key(F.lit(None), F.lit("The Café LLC"), F.lit("1 Main"), F.lit("92101"), F.lit("https://WWW.Cafe.com/x"), F.lit(""))
    assert one(spark, k) == "web:cafe.com"
    assert one(spark, keys.name_key_b(F.lit("The Café, L.L.C"))) == "cafe"
    assert one(spark, keys.is_owner_name(F.lit("Ortega, José"), F.lit("Jose Ortega")))
    assert one(spark, keys.cross_key(F.lit("LLC"), F.lit("1 Main"))) is None


def test_text(spark):
    assert one(spark, text.html_to_text(F.lit("<style>a{}</style><p>A&amp;B</p><div>C</div>"))) == "A&B\nC"
    assert "abcdefgh1234" not in one(spark, text.redact(F.lit('Authorization: Bearer abcdefgh1234')))
    assert one(spark, text.fold_accents(F.lit("ñandú"))) == "nandu"
    assert one(spark, money.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, money.round5(F.lit(122.5))) == 125


def test_tokens_round_trip(spark):
    signed = one(spark, crypto.sign_token(F.lit('{"id":1}'), "secret"))
    assert one(spark, crypto.verify_token(F.lit(signed), "secret")) == '{"id":1}'
    assert one(spark, crypto.verify_token(F.lit(signed + "x"), "secret")) is None
    assert one(spark, crypto.verify_token(F.lit(None).cast("string"), "secret")) is None


def test_anchored_window_restarts_after_it_ends():
    m = sequential.AnchoredWindow(2, 3600)
    at = [0, 10, 20, 3600, 3601, 3602, 3603]
    assert [m.hit(t * 1_000_000) for t in at] == [True, True, False, False, True, True, False]


def test_plan_is_noop_after_it_is_applied(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", 5)], "id int, x string, y int")
    first = {r["id"]: (r["action"], r["changed"]) for r in resolve.plan_changes(old, new, "id", ["x", "y"]).collect()}
    assert first == {1: ("noop", ""), 2: ("update", "x,y"), 3: ("orphan", ""), 4: ("create", "")}
    after = resolve.apply_plan(old, new.where("id <> 2"), "id", ["x", "y"])
    again = {r["id"]: r["action"] for r in resolve.plan_changes(after, new.where("id <> 2"), "id", ["x", "y"]).collect()}
    assert set(again.values()) <= {"noop", "orphan"}


def test_robots(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow: /z$"), ("b", "")], "host string, robots string")
    paths = spark.createDataFrame([("a", "/x/1"), ("a", "/x/y"), ("a", "/z"), ("a", "/zz"), ("b", "/x")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in web.robots_decision(paths, web.robots_rules(files, "us")).collect()}
    assert got == {("a", "/x/1"): False, ("a", "/x/y"): True, ("a", "/z"): False, ("a", "/zz"): True, ("b", "/x"): True}


def test_robots_files_of_a_host_are_read_apart(spark):
    one_more = [("a", "\nUser-agent: *\nDisallow: /y"), ("a", None), (None, "User-agent: *\nDisallow: /")]
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x"), *one_more], "host string, robots string")
    asked = [("a", "/x"), ("a", "/y"), ("a", "/y"), ("a", None), ("a", None), (None, "/y"), ("b", "/x"), ("b", "/x")]
    paths = spark.createDataFrame(asked, "host string, path string")
    got = [(r["host"], r["path"], r["allowed"]) for r in web.robots_decision(paths, web.robots_rules(files, "us")).collect()]
    assert sorted(got, key=str) == sorted([("a", "/x", False), ("a", "/y", False), ("a", None, True), (None, "/y", True), ("b", "/x", True)], key=str)


def test_robots_group_ends_at_the_next(spark):
    robots = "Allow: /lost\nUser-agent: x\nUser-agent: Us\nDisallow: /a # no\n\nSitemap: s\nDisallow:\nUser-agent: us\nDisallow: /b\nUser-agent: *\nDisallow: /"
    files = spark.createDataFrame([("a", robots), ("b", "User-agent: other\nDisallow: /"), ("c", "User-agent: *\r\nAllow: /z\r\n")], "host string, robots string")
    assert sorted(tuple(r) for r in web.robots_rules(files, "us").collect()) == [("a", "disallow", ""), ("a", "disallow", "/a"), ("c", "allow", "/z")]


def test_robots_meet_in_one_shuffle_that_copies_do_not_multiply(spark):
    files = spark.range(400).selectExpr("concat('h', id % 2) AS host", "'User-agent: *\nDisallow: /a\nAllow: /a/b' AS robots")
    paths = spark.range(4000).selectExpr("concat('h', id % 2) AS host", "concat('/a/', id % 10) AS path")
    out = web.robots_decision(paths, web.robots_rules(files, "us"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("rightHint=(strategy=broadcast)")  # only with the counts of hosts
    assert plan.count("RepartitionByExpression") == 1
    assert out.count() == 10 and out.where("allowed").count() == 0


def test_paths_of_one_host_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(web, "SHARE", 100)
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /1"), ("b", "")], "host string, robots string")
    paths = spark.range(4000).selectExpr("'a' AS host", "concat('/', id % 1000) AS path").union(spark.createDataFrame([("b", "/1"), ("b", "/1"), ("a", None)], "host string, path string"))
    out = web.robots_decision(paths, web.robots_rules(files, "us")).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == 1002 and sum(not r["allowed"] for r in out) == 111
    assert len({r["task"] for r in out if r["host"] == "a"}) > 1


def test_allowance_ramps_up(spark):
    day = F.lit("2024-01-08").cast("date")
    assert one(spark, guards.allowance(day, "2024-01-05")) == 25
    assert one(spark, guards.allowance(day, None)) == 40


def test_synthetic_leads_do_not_depend_on_partitions(spark):
    a = synthetic.leads(spark, 100).orderBy("id").collect()
    b = synthetic.leads(spark, 100).repartition(7).orderBy("id").collect()
    assert a == b


def test_payload_functions(spark):
    from leadloom.operators import payloads

    assert one(spark, payloads.locale(F.lit("ES-mx"))) == "es" and one(spark, payloads.locale(F.lit(None).cast("string"))) == "en"
    assert tuple(one(spark, payloads.name_parts(F.lit("  Luz  de la Vega ")))) == ("Luz", "de la Vega")
    assert one(spark, payloads.person(F.lit("Luz"), F.lit(True), F.lit("x"))) is None
    now = F.lit("2024-01-31 10:00:00").cast("timestamp")
    assert one(spark, payloads.retry_seconds(F.lit(" 120 "), now)) == 120
    assert one(spark, payloads.retry_seconds(F.lit("Wed, 31 Jan 2024 10:01:00 GMT"), now)) == 60
    assert one(spark, payloads.retry_seconds(F.lit("later"), now)) is None
    assert one(spark, payloads.signal(F.lit("new"), F.lit("2024-01-01"), F.lit("Permit Renewed"))) == "active_permit"
    assert one(spark, payloads.signal(F.lit("new"), F.lit("2024-01-01"), F.lit(None).cast("string"))) == "new_business"
    assert one(spark, payloads.duplicate_conflict(F.lit(500), F.lit(None).cast("string"), F.lit("A Duplicate entry")))


def test_projections(spark):
    from leadloom.operators import payloads

    rows = spark.createDataFrame([("1", " ", "Ola", "92101-22", None), ("2", None, None, "92102", "x")], "Id string, dba string, name string, ZIP string, city string")
    fields = {"source_id": ["ID"], "business_name": ["DBA", "Name"], "zip": ["zip"], "city": ["city"], "phone": ["phone"]}
    got = payloads.mapped_prospect(rows, fields, ["business_name"], "San Diego").collect()
    assert [tuple(r) for r in got] == [("1", "Ola", "92101", "San Diego", None)]
    p = spark.createDataFrame([(1, "Ola", "web:ola.com", "https://ola.com", "", "1 B St", "San Diego", None)], "id int, business_name string, dedupe_key string, website string, email string, address string, city string, zip string")
    body = payloads.company_body(p, ["dedupKey"]).first()["body"]
    assert '"name":"Ola"' in body and "dedupKey" not in body and "businessEmail" not in body and "addressPostcode" not in body
    assert one(spark, payloads.hydrated(F.lit("[1,2]"), "array<int>", F.array().cast("array<int>"))) == [1, 2]
    assert one(spark, payloads.hydrated(F.lit(None).cast("string"), "array<int>", F.array().cast("array<int>"))) == []
    assert one(spark, payloads.instant(F.lit("2024-01-31T10:00:00Z"))) == "2024-01-31T10:00:00.000Z"
    assert one(spark, payloads.label(F.lit("weekly"), {"weekly": "Weekly"})) == "Weekly" and one(spark, payloads.label(F.lit("x"), {})) == "x"
    assert one(spark, payloads.percent(F.lit(1), F.lit(8))) == 12.5 and one(spark, payloads.percent(F.lit(1), F.lit(0))) == 0


def test_postal_codes_of_more_digits_count_whole(spark):
    rows = [("153559", "see 15355"), ("153559", "see 153559"), ("92101-1234", "see 92101"), ("921011234", "see 92101"), ("92101", "see 9210")]
    df = spark.createDataFrame(rows, "postal string, html string")
    got = df.select(contact.page_evidence(F.col("html"), F.lit(""), F.lit(None).cast("string"), F.col("postal"), F.lit(None).cast("string")).alias("e")).collect()
    assert [r["e"] for r in got] == [[], ["zip"], ["zip"], ["zip"], []]


def test_running_totals_do_not_depend_on_rounding(spark, tmp_path):
    # As doubles these reach 2000.0000000000002, as decimals 2000.
    values = [596.27, 529.97, 160.44, 266.35, 446.97, 0.01]
    spark.createDataFrame([(k, k, 1, "view", v) for k, v in enumerate(values)], "event_id long, ts long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["over_budget"] for r in events.running_totals(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(6)] == [False] * 5 + [True]


def test_a_rule_is_evaluated_once_for_kind_and_reason(spark):
    out = chain.verdict(spark.createDataFrame([("zq",), ("a",), (None,)], "t string"), [("x", "one", F.col("t").rlike("zq")), ("y", "two", F.col("t") == "a")])
    assert [(r["kind"], r["reason"]) for r in out.collect()] == [("x", "one"), ("y", "two"), (None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("zq") == 1
