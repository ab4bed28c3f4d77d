"""Small scenarios with the rows they must give, and the edges of every limit."""

import json

import pytest
from pyspark.sql import functions as F

from builders import at, events, readings, transactions
from tidemark.functions import categories as C
from tidemark.functions.times import event_time, is_off_hours, micros
from tidemark.operators import alerts, dashboard, enrich, joins, keyed, metrics, patterns, routing, search, windows
from tidemark.sources import documents, parse, topics
from tidemark.streaming import jobs


def values(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def one_column(spark, rows, kind="double"):
    return spark.createDataFrame([(r,) for r in rows], f"v {kind}")


# Transactions ----------------------------------------------------------------------------------------------------

def test_six_rapid_transactions(spark, both):
    tx = transactions(spark, [(10 * i, 100 + 10 * i, "completed") for i in range(6)])
    assert sorted(values(patterns.velocity(tx), "allTotal")) == [(600.0,), (650.0,)]
    assert values(keyed.velocity_count(tx), "transactionCount") == [(6,)]


@pytest.mark.parametrize("last, hits", [(120.0, 0), (119.999, 1)])
def test_velocity_limit_is_exclusive(spark, both, last, hits):
    tx = transactions(spark, [(s, 1, "completed") for s in (0, 1, 2, 3, last)])
    assert patterns.velocity(tx).count() == hits


def test_velocity_count_includes_both_ends(spark, both):
    tx = transactions(spark, [(s, 1, "completed") for s in (0, 1, 2, 3, 4, 300)])
    assert values(keyed.velocity_count(tx), "transactionCount") == [(6,)]


def test_velocity_count_of_one_instant_counts_by_id(spark, both):
    tx = transactions(spark, [(0, 1, "completed")] * 7)
    assert sorted(values(keyed.velocity_count(tx), "transactionId", "transactionCount")) == [("t005", 6), ("t006", 7)]


def test_country_change_looks_at_the_next_completed_only(spark, both):
    tx = transactions(spark, [(0, 1, "completed", "US"), (10, 1, "completed", "US"), (20, 1, "failed", "FR"),
                              (30, 1, "completed", "DE")])
    assert values(patterns.country_change(tx), "transactionId", "endId") == [("t001", "t003")]


def test_card_testing_is_relaxed(spark, both):
    tx = transactions(spark, [(0, 1, "failed"), (1, 2, "completed"), (2, 3, "failed"), (3, 4, "failed"),
                              (4, 5, "completed")])
    assert values(patterns.card_testing(tx), "transactionId", "endId", "successTotal") == [("t000", "t004", 5.0)]


def test_structuring_starts_at_every_large_one(spark, both):
    tx = transactions(spark, [(0, 2000, "completed"), (1, 1000, "completed"), (2, 10, "completed"),
                              (3, 100, "completed"), (4, 20, "completed")])
    assert sorted(values(patterns.structuring(tx), "transactionId", "smallTotal")) == [("t000", 130.0), ("t001", 130.0)]


def test_rate_limit_over_two_minutes(spark):
    rows = spark.range(1000).select(
        F.format_string("t%04d", "id").alias("transactionId"), F.lit("u").alias("userId"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 100000).alias("ts"))
    assert keyed.rate_limit(rows).count() == 200


def test_split_keeps_the_limit_in_the_main_output(spark):
    tx = transactions(spark, [(0, 10000, "completed"), (1, 10000.01, "completed")])
    rest, hits = routing.split(tx, F.col("amount") > 10000, "HIGH_AMOUNT")
    assert values(rest, "amount") == [(10000.0,)]
    assert values(hits, "anomalyType") == [("HIGH_AMOUNT",)]


def test_fraud_alerts_agree_with_the_single_detectors(spark, both):
    tx = transactions(spark, [(i * 7 % 400, (i * 37) % 1500, "failed" if i % 3 == 0 else "completed",
                               ["US", "DE", "FR"][i % 3], f"u{i % 2}") for i in range(60)])
    kinds = dict(values(alerts.fraud_alerts(tx).groupBy("alertType").count(), "alertType", "count"))
    single = {"VELOCITY_FRAUD": patterns.velocity(tx), "STRUCTURING_FRAUD": patterns.structuring(tx),
              "GEOGRAPHIC_ANOMALY": patterns.country_change(tx), "TESTING_ATTACK": patterns.card_testing(tx),
              "OFF_HOURS_HIGH_RISK": patterns.off_hours(tx)}
    assert kinds == {k: n for k, df in single.items() if (n := df.count())}


# Sensors ---------------------------------------------------------------------------------------------------------

def test_jump_in_temperature(spark, both):
    rows = readings(spark, [(5 * i, v) for i, v in enumerate([20, 21, 22, 20.5, 21.5, 45, 50, 55])])
    assert values(keyed.rapid_change(rows), "previousValue", "value", "severity") == [(21.5, 45.0, 0.9)]
    assert keyed.zscore_alerts(rows).count() == 0
    assert enrich.threshold_violations(rows).count() == 0


def test_outlier_after_ten_calm_readings(spark, both):
    calm = [22.0 + i / 10 for i in range(10)]
    rows = readings(spark, [(5 * i, v) for i, v in enumerate([*calm, 50, 55, 60, 65, 70])])
    assert [(i, round(z, 4)) for i, z in values(keyed.zscore_alerts(rows), "readingId", "zScore")] == [(10, 3.1604)]
    assert values(keyed.rapid_change(rows), "value") == [(50.0,)]


def test_zscore_needs_ten_readings_and_spread(spark, both):
    assert keyed.zscore_alerts(readings(spark, [(i, 5.0) for i in range(20)])).count() == 0
    assert keyed.zscore_alerts(readings(spark, [(i, v) for i, v in enumerate([1] * 8 + [9])])).count() == 0
    assert keyed.zscore_alerts(readings(spark, [(i, v) for i, v in enumerate([1] * 9 + [9])])).count() == 1


def test_zscore_sees_a_hundred_readings(spark, both):
    rows = readings(spark, [(i, 1000.0 if i == 0 else float(i % 2)) for i in range(101)])
    late = readings(spark, [(i, 1000.0 if i == 0 else float(i % 2)) for i in range(100)] + [(100, 9.0)])
    assert values(keyed.zscore_alerts(rows), "readingId") == []
    assert values(keyed.zscore_alerts(late), "readingId", "readings") == [(100, 100)]


@pytest.mark.parametrize("gap, hits", [(300.0, 0), (300.001, 1)])
def test_gap_limit(spark, both, gap, hits):
    rows = readings(spark, [(0, 1), (gap, 1)])
    assert keyed.data_gaps(rows).count() == hits
    assert keyed.offline(rows).count() == hits


def test_offline_at_the_end_follows_the_watermark(spark, both):
    rows = readings(spark, [(0, 1, "a"), (309.999, 1, "b")])
    assert keyed.offline(rows).count() == 0
    rows = readings(spark, [(0, 1, "a"), (310, 1, "b")])
    assert [r[0] for r in values(keyed.offline(rows), "sensorId")] == ["a"]


@pytest.mark.parametrize("value, hits", [(0, 0), (1, 1)])
def test_change_from_zero(spark, value, hits):
    assert keyed.rapid_change(readings(spark, [(0, 0), (1, value)])).count() == hits


@pytest.mark.parametrize("dt, hits", [(0, 0), (299.9, 1), (300, 0)])
def test_rapid_change_time_limits(spark, both, dt, hits):
    assert keyed.rapid_change(readings(spark, [(0, 1), (dt, 9)])).count() == hits


def test_statistics_and_trend_of_one_window(spark):
    rows = readings(spark, [(i, 20 + i % 10, f"s{i % 5}") for i in range(20)])
    assert values(windows.sensor_stats(rows), "count", "sum", "average", "minimum") == [(20, 490.0, 24.5, 20.0)]
    trends = values(windows.sensor_trend(rows), "dataPoints", "trend", "trendDirection")
    assert len(trends) == 5
    assert {(n, round(t, 7), d) for n, t, d in trends} == {(20, 0.2481203, "INCREASING")}
    assert values(windows.sensor_trend(rows, slice_width="10 seconds"), "dataPoints", "trendDirection") == [
        (20, "INCREASING")] * 5
    assert windows.deviation_candidates(rows).count() == 0


def test_deviation_tie_goes_to_the_smaller_sensor(spark):
    rows = readings(spark, [(0, 31, "b"), (1, 20, "a")])
    assert values(windows.deviation_candidates(rows), "sensorId", "mean", "deviation", "severity") == [
        ("a", 25.5, 5.5, 0.55)]
    assert values(windows.deviation_candidates(readings(spark, [(0, 31, "a"), (1, 20, "b")])), "sensorId") == [("a",)]


def test_count_batches(spark, both):
    rows = readings(spark, [(i, i) for i in range(25)])
    summaries, inside = keyed.count_batches(rows, 10)
    assert sorted(values(summaries, "batch", "batchSize", "averageValue")) == [(0, 10, 4.5), (1, 10, 14.5), (2, 5, 22.0)]
    full, inside = keyed.count_batches(rows, 10, partial=False)
    assert full.count() == 2 and inside.count() == 20


# Sessions and users ----------------------------------------------------------------------------------------------

def test_one_session_is_active_then_ended(spark, both):
    visit = [(0, "login", "a"), (10, "page_view", "a"), (20, "purchase", "a"), (30, "logout", "a")]
    shown = ("sessionId", "eventCount", "duration", "status")
    assert values(keyed.sessions(events(spark, visit)), *shown) == [("a", 4, 30000, "active")]
    more = events(spark, [*visit, (40, "login", "b")])
    assert sorted(values(keyed.sessions(more), *shown)) == [("a", 4, 30000, "ended"), ("b", 1, 0, "active")]


def test_session_gap_of_thirty_minutes(spark, both):
    rows = values(keyed.sessions(events(spark, [(0, "x", "a"), (1800, "x", "a")])), "sessionStart", "status")
    assert sorted(s for _, s in rows) == ["active", "timeout"]
    assert keyed.sessions(events(spark, [(0, "x", "a"), (1799.999, "x", "a")])).count() == 1


def test_sessions_without_id_do_not_fail(spark, both):
    rows = values(keyed.sessions(events(spark, [(0, "parse_error", None), (1, "parse_error", None)])), "eventCount")
    assert rows == [(2,)]


def test_sessions_that_alternate(spark, both):
    rows = events(spark, [(i, "x", "ab"[i % 2]) for i in range(12)])
    assert keyed.sessions(rows).count() == 12


def test_running_stats(spark, both):
    rows = events(spark, [(0, "a", "s"), (1, "b", "s"), (3, "a", "s"), (3.5, None, "s"), (10, "a", "s"), (11, None, "s")])
    out = values(keyed.running_stats(rows, "eventType").orderBy("ts"), "lastProcessingInterval", "eventTypeCount")
    assert out == [(0, 1), (1000, 1), (2000, 2), (500, 1), (6500, 3), (1000, 2)]


def test_dedupe(spark):
    rows = events(spark, [(0, "x", "a")] * 5).withColumn("id", F.lit("same"))
    assert values(keyed.dedupe(rows, "id", ["ts", "eventId"]), "eventId") == [(0,)]


def test_asof_needs_the_event_first(spark, both):
    tx = transactions(spark, [(10, 5, "completed")])
    before, after = events(spark, [(5, "login", "s")]), events(spark, [(15, "login", "s")])
    assert joins.asof_join(tx, before, "userId", "profile", "eventId").count() == 1
    assert joins.asof_join(tx, after, "userId", "profile", "eventId").count() == 0
    assert joins.asof_join(tx, after, "userId", "profile", "eventId", how="left").count() == 1
    assert joins.asof_join(tx, before, "userId", "p", "eventId", tolerance="4 seconds").count() == 0


def test_asof_far_back_over_many_slices(spark, both):
    tx = transactions(spark, [(10 + i, i, "completed") for i in range(20)])
    users = events(spark, [(0, "login", "s")])
    out = joins.asof_join(tx, users, "userId", "profile", "eventId")
    assert values(out.groupBy("profile.eventType").count(), "eventType", "count") == [("login", 20)]


# Parsing ---------------------------------------------------------------------------------------------------------

def test_times_in_every_form(spark):
    rows = one_column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123456+00:00", "1704067200000", "soon", None], "string")
    shown = [r[0] for r in rows.select(F.unix_micros(event_time(F.col("v")))).collect()]
    assert shown == [1704067200000000, 1704067200123456, 1704067200000000, None, None]


def test_broken_user_events_become_errors(spark):
    good = {"userId": "u", "sessionId": "s", "eventType": "click", "timestamp": "2024-01-01T00:00:00Z", "duration": 5}
    lost = {k: v for k, v in good.items() if k != "sessionId"}
    rows = one_column(spark, [json.dumps(good), '{"userId": "u', json.dumps(lost)], "string").withColumnRenamed("v", "value")
    out = values(parse.parse_user_events(rows), "userId", "eventType", "additionalData")
    assert out == [("u", "click", {"duration": "5"}), ("unknown", "parse_error", None), ("unknown", "parse_error", None)]


def test_incomplete_transactions_and_readings_are_dropped(spark):
    tx = {"transactionId": "t", "userId": "u", "amount": 5, "currency": "USD", "status": "completed", "timestamp": 1704067200000}
    rows = one_column(spark, [json.dumps(tx), json.dumps({**tx, "amount": None}), "no"], "string").withColumnRenamed("v", "value")
    assert values(parse.parse_transactions(rows), "transactionId", "riskScore", "country", "merchantId") == [
        ("t", 0.0, "UNKNOWN", "UNKNOWN")]
    reading = {"sensorId": "s", "deviceType": "motion", "value": True, "unit": "b", "location": "x", "timestamp": "2024-01-01T00:00:00Z"}
    rows = one_column(spark, [json.dumps(reading), json.dumps({**reading, "location": None})], "string").withColumnRenamed("v", "value")
    assert values(parse.parse_sensors(rows), "sensorType", "value", "batteryLevel") == [("motion", 1.0, 100)]


def test_evolution(spark):
    old = spark.createDataFrame([("u", "2024-01-01T00:00:00Z")], "user_id STRING, timestamp STRING")
    new = parse.evolve(old, {"userId": ["user_id"]}, {"region": "unknown"})
    assert "user_id" not in new.columns
    assert values(new.withColumn("timestamp", F.unix_micros("timestamp")), "userId", "timestamp", "region", "schemaVersion") == [
        ("u", 1704067200000000, "unknown", "2.0")]


def test_generic_json(spark):
    rows = one_column(spark, ['{"a": {"b": 1}}', "{oops"], "string").withColumnRenamed("v", "value")
    kept = parse.parse_generic(rows)
    assert values(kept, "error", "original") == [(None, None), ("Invalid JSON", "{oops")]
    assert values(parse.parse_generic(rows, "drop").select(parse.field("a.b", "int").alias("b")), "b") == [(1,)]


def test_messages_are_tagged_and_filtered(spark):
    rows = spark.createDataFrame([("user-events", 0, 1, "{}"), ("other", 0, 2, "{}"), ("user-events", 0, 3, ""),
                                  ("user-events", 0, 4, "nope")], "topic STRING, partition INT, offset BIGINT, value STRING")
    sent = topics.envelope(topics.tagged(rows), F.timestamp_millis(F.lit(7)))
    assert values(sent, "type", "offset", "timestamp") == [("user_event", 1, 7), ("unknown", 2, 7)]


# Functions -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("label, cases", [
    (C.risk_category, {0.8: "high", 0.79: "medium", 0.5: "medium", 0.49: "low", 0.2: "low", 0.19: "very_low", None: None}),
    (C.amount_category, {1000.0: "large", 999.99: "medium", 100.0: "medium", 99.99: "small", 10.0: "small", 9.99: "micro"}),
    (C.battery_status, {80.0: "excellent", 79.0: "good", 50.0: "good", 49.0: "low", 20.0: "low", 19.0: "critical"}),
    (lambda v: C.value_range(v, F.lit("Temperature")),
     {9.99: "very_low", 10.0: "low", 17.99: "low", 18.0: "normal", 26.0: "normal", 26.01: "high", 35.0: "high", 35.01: "very_high"}),
    (lambda v: C.value_range(v, F.lit("humidity")),
     {19.9: "very_low", 20.0: "low", 30.0: "normal", 70.0: "normal", 70.1: "high", 85.0: "high", 85.1: "very_high"}),
    (lambda v: C.value_range(v, F.lit("sound")), {1.0: "unknown"}),
])
def test_bands(spark, label, cases):
    rows = one_column(spark, list(cases)).select("v", label(F.col("v")).alias("label"))
    assert dict(values(rows, "v", "label")) == cases


@pytest.mark.parametrize("label, cases", [
    (C.event_category, {"PAGE_VIEW": "engagement", "search": "search", "purchase": "commerce", "login": "authentication", "x": "other"}),
    (C.region, {"US": "North America", "UK": "Europe", "AU": "Oceania", "IN": "Asia", "BR": "South America", "us": "Other"}),
    (C.timezone, {"JP": "Asia/Tokyo", "FR": "UTC"}),
    (C.merchant_type, {"Grocery": "food_beverage", "atm": "other", "airline": "travel"}),
    (C.sensor_category, {"sound": "security", "light": "comfort", "power": "industrial", "x": "other"}),
    (C.location_category, {"office_warehouse": "storage", "production_line_1": "manufacturing", "cafeteria": "other", "Office": "other"}),
])
def test_labels(spark, label, cases):
    rows = one_column(spark, list(cases), "string").select("v", label(F.col("v")).alias("label"))
    assert dict(values(rows, "v", "label")) == cases


def test_off_hours(spark):
    clock = {"05:59": True, "06:59": True, "07:00": False, "21:59": False, "22:00": True}
    rows = one_column(spark, list(clock), "string").select(
        "v", is_off_hours(F.concat(F.lit("2024-01-01 "), F.col("v")).cast("timestamp")).alias("off"))
    assert dict(values(rows, "v", "off")) == clock


def test_threshold_edges(spark):
    rows = readings(spark, [(0, 85), (1, 86), (2, -40), (3, -60)])
    out = values(enrich.threshold_violations(rows), "value", "severity")
    assert sorted(out) == [(-60.0, 0.9), (86.0, 0.05)]


def test_spans():
    assert micros("5 minutes") == 300_000_000
    assert micros("1 hour 30 minutes") == 5_400_000_000
    with pytest.raises(ValueError):
        micros("soon")


# Documents, search, dashboard, metrics ---------------------------------------------------------------------------

def test_document_ids_and_routes(spark):
    rows = spark.createDataFrame([("t", None, "u", "2024-01-01T00:00:00Z"), (None, "s", None, "2024-01-01T00:00:00Z"),
                                  (None, None, "u", "2024-01-01T00:00:00Z")],
                                 "transactionId STRING, sensorId STRING, userId STRING, timestamp STRING")
    out = values(documents.route_index(documents.doc_id(rows)), "doc_id", "index")
    assert out == [("t", "transaction-events"), ("s_2024_01_01T00_00_00Z", "iot-sensor-events"),
                   ("u_2024_01_01T00_00_00Z", "user-events")]


def test_upsert_can_be_repeated_and_folded(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame(rows, "doc_id STRING, ts INT, v STRING").withColumn("index", F.lit("i"))

    schema, root = batch([("a", 1, "x")]).drop("index").schema, str(tmp_path / "docs")
    documents.upsert(batch([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")]), root, 0, ["ts"])
    for _ in range(2):
        documents.upsert(batch([("a", 2, "later"), ("c", 1, "c"), ("b", 0, "late")]), root, 1, ["ts"])
    want = [("a", 2, "later"), ("b", 1, "b"), ("c", 1, "c")]
    assert sorted(values(documents.read_documents(spark, root, schema, ["ts"]), "doc_id", "ts", "v")) == want
    folded = str(tmp_path / "folded")
    documents.fold(spark, root, folded, schema, ["ts"])
    assert sorted(values(documents.read_documents(spark, folded, schema, ["ts"], index="i"), "doc_id", "ts", "v")) == want


def test_bulk_load_counts(spark, tmp_path):
    assert values(documents.bulk_load(spark.range(1000).toDF("id"), str(tmp_path / "t")), "sent", "stored") == [(1000, 1000)]


def test_writers_do_not_touch_each_other(spark, tmp_path):
    def batch(ids, index):
        return spark.createDataFrame([(i, 1) for i in ids], "doc_id STRING, ts INT").withColumn("index", F.lit(index))

    def ids(root, **which):
        return sorted(r.doc_id for r in documents.read_documents(spark, root, schema, ["ts"], **which).collect())

    schema, root = batch(["a"], "x").drop("index").schema, str(tmp_path / "docs")
    for writer, index in (("tx", "transaction-events"), ("iot", "iot-sensor-events"), ("user", "user-events")):
        documents.upsert(batch([f"{writer}1", f"{writer}2"], index), root, 0, ["ts"], writer=writer)
    assert ids(root) == ["iot1", "iot2", "tx1", "tx2", "user1", "user2"]
    assert ids(root, index="user-events") == ["user1", "user2"] and ids(root, ident="tx2") == ["tx2"]
    folded = str(tmp_path / "folded")
    documents.fold(spark, root, folded, schema, ["ts"])
    documents.upsert(batch(["new"], "user-events"), folded, 0, ["ts"], writer="user")
    assert ids(folded) == ["iot1", "iot2", "new", "tx1", "tx2", "user1", "user2"]
    with pytest.raises(ValueError):
        documents.fold(spark, root, root, schema, ["ts"])


def test_unreadable_messages_keep_their_own_documents(spark):
    messages = spark.createDataFrame([("user-events", 0, i, "not json" if i % 2 else None) for i in range(20)],
                                     "topic STRING, partition INT, offset BIGINT, value STRING")
    first, again = (jobs.documents_of(messages, "user").select("doc_id", "raw").collect() for _ in range(2))
    assert len({r.doc_id for r in first}) == 20 and {r.doc_id for r in first} == {r.doc_id for r in again}
    assert {r.raw for r in first} == {"not json", None}


def test_histogram_over_a_wide_gap(spark):
    rows = spark.createDataFrame([("1970-01-02 00:00:30",), ("2024-01-01 00:00:00",)], "t STRING").select(F.col("t").cast("timestamp").alias("ts"))
    found = search.date_histogram(rows, "ts", "1 minute", {})
    assert found.agg(F.count("*"), F.sum("doc_count")).first()[0:2] == (28_399_681, 2)


def test_unknown_time_range_raises(spark):
    with pytest.raises(ValueError):
        dashboard.filter_tx(transactions(spark, [(0, 1, "completed")]), dashboard.Filter(time_range="2h"))


def test_conform_adds_and_casts(spark):
    rows = spark.createDataFrame([("12.5", "u", 1)], "amount STRING, userId STRING, extra INT")
    out = documents.conform(rows, "transaction-events-2024")
    assert "extra" not in out.columns and dict(out.dtypes)["amount"] == "double"
    assert values(out, "amount", "userId", "status") == [(12.5, "u", None)]
    assert documents.conform(rows, "anything") is rows


def test_amount_ranges_and_terms(spark):
    rows = transactions(spark, [(i, a, "completed") for i, a in enumerate(
        [10.5, 25.75, 100, 250, 500, 1000, 2500, 5000, 7500, 10000])]).withColumn("isFraud", F.col("amount") > 5000)
    assert search.all_of(rows, search.range_("amount", gte=1000)).count() == 5
    assert search.all_of(rows, search.term("isFraud", True)).count() == 2


def test_terms_buckets(spark):
    kinds = ["temperature", "humidity", "pressure", "light", "motion"]
    rows = spark.range(50).select(F.get(F.array(*map(F.lit, kinds)), (F.col("id") % 5).cast("int")).alias("sensorType"))
    assert values(search.terms_agg(rows, "sensorType"), "doc_count") == [(10,)] * 5


def test_hours_of_transactions(spark):
    rows = transactions(spark, [(86400 - 3600 * i - 600 * j, 50 + i * j, "completed") for i in range(24) for j in range(5)])
    recent = search.all_of(rows, search.range_("ts", gte=F.lit(at(86400 - 12 * 3600)), lte=F.lit(at(86400))))
    assert recent.count() == 61
    hours = search.date_histogram(rows, "ts", "1 hour", {"total": F.sum("amount")})
    assert hours.agg(F.sum("total")).first()[0] == 8760.0


def test_histogram_has_the_empty_hours(spark):
    rows = transactions(spark, [(0, 1, "completed"), (3 * 3600, 2, "completed")])
    out = search.date_histogram(rows, "ts", "1 hour", {"total": F.sum("amount")}).orderBy("bucket")
    assert values(out, "doc_count", "total") == [(1, 1.0), (0, None), (0, None), (1, 2.0)]
    assert search.date_histogram(rows.where("false"), "ts", "1 hour", {}).count() == 0


def test_clauses_over_documents(spark):
    rows = spark.range(5000).select(F.concat(F.lit("category_"), F.col("id") % 10).alias("category"),
                                    (F.col("id") * 0.1).alias("value"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    found = search.all_of(rows, search.range_("value", 100, 400), search.term("category", "category_5"))
    assert found.count() == 300
    assert search.all_of(rows, search.has_tag("tags", "b")).count() == 5000


def test_paging_reaches_every_row(spark):
    rows, last, seen = spark.range(250).toDF("k"), None, []
    while got := [r[0] for r in search.page(rows, "k", last).collect()]:
        seen, last = seen + got, got[-1]
    assert seen == list(range(250))


def test_order_within_key(spark, both):
    good = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.col("id").alias("seq"))
    assert search.order_violations(good, "k", "o", "seq").count() == 0
    bad = good.withColumn("seq", F.when(F.col("o") == 5, 1).otherwise(F.col("seq")))
    assert values(search.order_violations(bad, "k", "o", "seq"), "o") == [(5,)]


def test_filters_and_presets(spark):
    tx = transactions(spark, [(0, 5000, "completed"), (3600, 1500, "completed"), (3700, 10, "completed")])
    assert values(dashboard.filter_tx(tx, dashboard.preset("high-value")), "amount") == [(1500.0,)]
    assert dashboard.filter_tx(tx, dashboard.preset("recent")).count() == 1
    users = events(spark, [(0, "a", "s"), (1, "b", "s")])
    assert dashboard.filter_users(users, dashboard.Filter(event_types=["b"])).count() == 1
    assert dashboard.filter_users(users, dashboard.Filter(countries=["FR"])).count() == 0


def test_share_of_nothing(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0)], "label STRING, n INT")
    assert values(dashboard.share(rows, "label", "n"), "percent") == [(0.0,), (0.0,)]


def test_freshness(spark):
    rows = events(spark, [(0, "a", "s")])
    assert values(dashboard.freshness(rows, F.lit(at(5))), "stale") == [(False,)]
    assert values(dashboard.freshness(rows, F.lit(at(5.001))), "stale") == [(True,)]


def test_counter_that_restarts(spark, both):
    rows = spark.createDataFrame([("c", at(60 * i), float(v)) for i, v in enumerate([10, 20, 30, 5, 15, 25])],
                                 "name STRING, ts TIMESTAMP, total DOUBLE")
    out = values(metrics.counter_rate(rows, ["name"], "ts", "total", "2 minutes").orderBy("ts"), "rate")
    want = [None, 10 / 60, 20 / 120, 15 / 120, 15 / 120, 20 / 120]
    assert [r[0] and round(r[0], 9) for r in out] == [w and round(w, 9) for w in want]
    steps = values(metrics.instant_rate(rows, ["name"], "ts", "total").orderBy("ts"), "irate")
    assert [r[0] and round(r[0] * 60, 6) for r in steps] == [None, 10, 10, 5, 10, 10]


def test_sustained_condition(spark, both):
    rows = spark.createDataFrame([("c", at(60 * i), v) for i, v in enumerate([1, 9, 9, 9, 1, 9, 9, 1])], "name STRING, ts TIMESTAMP, v INT")
    out = metrics.sustained(rows, ["name"], "ts", F.col("v") > 5, "2 minutes")
    assert values(out, "samples") == [(3,)]


def test_observed_counts(spark):
    rows, seen = metrics.observe(spark.range(10).toDF("latency"), "transactions", "latency")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"processed": 10, "meanLatency": 4.5, "maxLatency": 9}


def test_retention_and_compaction(spark):
    rows = events(spark, [(0, "a", "s"), (86400, "b", "s"), (86400 * 2, "c", "s")])
    assert documents.retain(rows, "ts", "1 day").count() == 2
    assert values(documents.compact_latest(rows, ["userId"], ["ts", "eventId"]), "eventType") == [("c",)]


def test_risk_score_terms(spark, both):
    tx = transactions(spark, [(0, 100, "completed"), (30, 100, "completed"), (40, 1000, "completed"), (7 * 3600, 100, "completed", "RU")])
    tx = tx.withColumn("isFraud", F.col("amount") == 1000)
    profiles = spark.createDataFrame([("u", 100.0, "US", ["retail"])], "userId STRING, averageAmount DOUBLE, homeCountry STRING, preferredCategories ARRAY<STRING>")
    out = values(enrich.risk_score(tx, profiles).orderBy("ts"), "priorFrauds", "score", "decision")
    assert out == [(0, 0.2, "approved"), (0, 0.5, "approved"), (0, 0.8, "declined_or_review"), (1, 0.5, "approved")]
