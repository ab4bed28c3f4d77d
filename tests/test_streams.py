"""Streams give what tables give: the events arrive in shuffled files, one per batch, then a last one far ahead."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from builders import SF
from tidemark.operators import alerts, enrich, joins, keyed, patterns, routing, windows
from tidemark.sources import adapters, documents, topics
from tidemark.streaming import jobs
from tidemark.streaming import operators as O

DELAY = {"delay": "12 hours"}
LIMITS = {"velocity_within": "1 day", "structuring_within": "5 days", "country_within": "6 hours",
          "testing_within": "72 hours"}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """(table, stream) of the same events; the stream is up to three hours out of order across three files."""
    root = str(tmp_path_factory.mktemp("feed"))
    rows = adapters.table(spark, SF, "events")
    late = F.unix_micros("ts") + F.pmod(F.hash("event_id"), F.lit(10800)).cast("bigint") * 1_000_000
    parts = rows.withColumn("_f", F.ntile(3).over(Window.orderBy(late))).persist()
    for i in (1, 2, 3):
        parts.where(F.col("_f") == i).drop("_f").coalesce(1).write.mode("append").parquet(root)
    last = spark.sql("SELECT -1L AS event_id, TIMESTAMP '2030-01-01' AS ts, -1L AS user_id, 'purchase' AS event_type, "
                     "1.0D AS value, '{\"k\": 50}' AS props")
    last.coalesce(1).write.mode("append").parquet(root)
    parts.unpersist()
    everything = rows.unionByName(last)

    def stream():
        return (spark.readStream.schema(adapters.SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(root))

    return everything, stream


@pytest.fixture
def drain(spark, tmp_path, request):
    made = []

    def run(df, mode="append"):
        name = f"out_{abs(hash(request.node.name))}_{len(made)}"
        made.append(name)
        query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
                 .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.table(name)

    yield run
    for name in made:
        spark.catalog.dropTempView(name)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def same(stream, table, *names):
    """Equal rows but for those of the last message, whose windows and timers are still open."""
    mine, theirs = rows(stream, *names), rows(table, *names)
    key = lambda r: not any("_-1" in str(v) or "2030" in str(v) for v in r)
    mine, theirs = [r for r in mine if key(r)], [r for r in theirs if key(r)]
    assert mine and mine == theirs


def test_window_counts(feed, drain):
    table, stream = feed
    live = windows.count_by_user_type(adapters.user_events_of(stream()).withWatermark("ts", "12 hours"), "1 day")
    same(drain(live), windows.count_by_user_type(adapters.user_events_of(table), "1 day"), "key", "window_start", "count")


def test_page_stats_and_trend(feed, drain):
    table, stream = feed
    live = windows.page_stats(adapters.user_events_of(stream()).withWatermark("ts", "12 hours"), "1 day")
    same(drain(live), windows.page_stats(adapters.user_events_of(table), "1 day"), "page", "window_start", "pageViews",
         "uniqueUsers", F.round("avgDuration", 6))
    sensors = adapters.sensors_of(stream()).withWatermark("ts", "12 hours")
    live = routing.sensor_aggregates(sensors, "6 hours", "10 hours", "2 hours", slice_width="30 minutes")
    want = routing.sensor_aggregates(adapters.sensors_of(table), "6 hours", "10 hours", "2 hours")
    same(drain(live), want, "sensorType", "window_start", "aggregationType", F.coalesce("count", "dataPoints"),
         F.coalesce("trendDirection", F.lit("-")), F.round(F.coalesce("trend", "sum"), 6))


def test_deviations(feed, drain):
    table, stream = feed
    live = windows.deviation_candidates(adapters.sensors_of(stream()).withWatermark("ts", "12 hours"), "1 day")
    same(drain(live), windows.deviation_candidates(adapters.sensors_of(table), "1 day"), "location", "window_start", "readingId")


def test_sessions(feed, drain):
    table, stream = feed
    same(drain(O.sessions(adapters.user_events_of(stream()), "3 hours", **DELAY)),
         keyed.sessions(adapters.user_events_of(table), "3 hours"),
         "userId", "sessionId", "sessionStart", "sessionEnd", "duration", "eventCount", "status")


def test_sensor_rules(feed, drain):
    table, stream = feed
    live, still = adapters.sensors_of(stream()), adapters.sensors_of(table)
    same(drain(O.zscore_alerts(live, **DELAY)), keyed.zscore_alerts(still), "readingId", F.round("zScore", 6), F.round("mean", 6))
    same(drain(O.rapid_change(live, "2 hours", **DELAY)), keyed.rapid_change(still, "2 hours"), "readingId", F.round("relativeChange", 6))
    same(drain(O.data_gaps(live, "8 hours", **DELAY)), keyed.data_gaps(still, "8 hours"), "readingId", F.round("minutes", 6))
    same(drain(O.offline(live, "8 hours", **DELAY)), keyed.offline(still, "8 hours"), "sensorId", "readingId", "lastSeen", "ts")


def test_user_rules(feed, drain):
    table, stream = feed
    live, still = adapters.transactions_of(stream()), adapters.transactions_of(table)
    same(drain(O.velocity_count(live, "1 day", **DELAY)), keyed.velocity_count(still, "1 day"), "transactionId", "transactionCount")
    same(drain(O.rate_limit(live, "1 day", 3, **DELAY)), keyed.rate_limit(still, "day", 3), "transactionId", "ts")
    live, still = adapters.user_events_of(stream()), adapters.user_events_of(table)
    same(drain(O.running_stats(live, "eventType", forget=None, **DELAY)), keyed.running_stats(still, "eventType"),
         "userId", "eventId", "lastProcessingInterval", "eventTypeCount")


def test_count_batches(feed, drain):
    table, stream = feed
    out = drain(O.count_batches(adapters.sensors_of(stream()), 20, **DELAY))
    summaries, inside = keyed.count_batches(adapters.sensors_of(table), 20, partial=False)
    same(out.where("kind = 'summary'"), summaries.withColumnRenamed("averageValue", "batchAverage"),
         "sensorType", "batch", "batchSize", F.round("batchAverage", 6))
    same(out.where("kind = 'row'"), inside, "readingId", "batch", F.round("batchAverage", 6))


def test_patterns(feed, drain):
    table, stream = feed
    live, still = adapters.transactions_of(stream()), adapters.transactions_of(table)
    for mine, theirs, within in ((O.velocity, patterns.velocity, "1 day"), (O.structuring, patterns.structuring, "5 days"),
                                 (O.card_testing, patterns.card_testing, "72 hours")):
        same(drain(mine(live, within=within, **DELAY)).withColumnRenamed("startId", "transactionId"),
             theirs(still, within=within), "transactionId", "endId", "endTs")
    same(drain(O.country_change(live, "6 hours", **DELAY)), patterns.country_change(still, "6 hours"), "transactionId", "endId", "nextCountry")


def test_alerts_together(feed, drain):
    table, stream = feed
    live, still = adapters.transactions_of(stream()), adapters.transactions_of(table)
    same(drain(O.fraud_alerts(live, **LIMITS, **DELAY)), alerts.fraud_alerts(still, **LIMITS),
         "alertId", "ts", "alertType", "userId", "transactionId", "title", "description", "severity", "status", "source")
    live, still = adapters.sensors_of(stream()), adapters.sensors_of(table)
    limits = {"max_dt": "2 hours", "timeout": "8 hours", "deviation_window": "1 day"}
    want, got = alerts.anomaly_alerts(still, **limits), drain(O.anomaly_alerts(live, **limits, **DELAY))
    assert got.where("alertType = 'CORRELATION_ANOMALY'").count() > 0
    same(got, want, "alertId", "ts", "alertType", "sensorId",
         "deviceType", "location", "value", "unit", "readingTimestamp", "title", "description", F.round("severity", 6), "status", "source")


def test_asof(feed, drain):
    table, stream = feed
    live = O.asof_join(adapters.transactions_of(stream()), adapters.user_events_of(stream()).where("eventType = 'signup'"),
                       "userId", "e", "eventId", **DELAY)
    want = joins.asof_join(adapters.transactions_of(table), adapters.user_events_of(table).where("eventType = 'signup'"),
                           "userId", "e", "eventId")
    same(drain(live), want, "transactionId", "ts", "amount", "e.eventId", "e.ts")


def test_asof_no_older_than(feed, drain):
    table, stream = feed
    options = {"tolerance": "3 days", "how": "left"}
    live = O.asof_join(adapters.transactions_of(stream()), adapters.user_events_of(stream()).where("eventType = 'signup'"),
                       "userId", "e", "eventId", **options, **DELAY)
    want = joins.asof_join(adapters.transactions_of(table), adapters.user_events_of(table).where("eventType = 'signup'"),
                           "userId", "e", "eventId", **options)
    assert 0 < want.where("e IS NULL").count() < want.count()
    same(drain(live), want, "transactionId", "ts", "e.eventId", "e.ts")


def test_topic_totals(feed, drain):
    table, stream = feed
    live = adapters.user_events_of(stream()).withColumnRenamed("eventType", "topic").withWatermark("ts", "12 hours")
    want = windows.topic_stats(adapters.user_events_of(table).withColumnRenamed("eventType", "topic"), "6 hours")
    same(drain(windows.topic_stats(live, "6 hours")), want, "topic", "window_start", "window_end", "messages", "totalMessages",
         "messagesPerSecond")


def test_risk_score(feed, drain):
    table, stream = feed
    want = enrich.risk_score(adapters.transactions_of(table))
    same(drain(O.risk_score(adapters.transactions_of(stream()), **DELAY)), want, "transactionId", "userId", "ts", "amount",
         "priorFrauds", "score", "decision")


def test_dedupe(feed, drain):
    _, stream = feed
    out = drain(keyed.dedupe(adapters.user_events_of(stream()), "userId", [], "ts", "40 days"))
    assert out.groupBy("userId").count().where("count > 1").count() == 0


def test_documents_of_a_stream(spark, feed, tmp_path):
    table, stream = feed
    docs = documents.route_index(adapters.user_events_of(stream()).withColumn("doc_id", F.col("userId")))
    root = str(tmp_path / "docs")
    query = (jobs.to_documents(docs, root, str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = docs.drop("index").schema
    got = documents.read_documents(spark, root, schema, ["ts"], index="user-events")
    want = documents.compact_latest(adapters.user_events_of(table), ["userId"], ["ts"])
    assert rows(got, "userId", "ts", "eventId") == rows(want, "userId", "ts", "eventId")


def test_topics_and_jobs_from_files(spark, tmp_path, drain):
    messages = adapters.user_messages(spark, SF).unionByName(adapters.transaction_messages(spark, SF))
    messages.write.parquet(str(tmp_path / "topic"))
    feed = topics.read_topics(spark, ["user-events"], "parquet", str(tmp_path / "topic"))
    streams = jobs.user_events(feed, "1 day")
    counted = drain(streams["event_aggregation"])
    assert counted.count() > 0 and set(counted.columns) == {"key", "userId", "eventType", "count", "window_start", "window_end"}
    tagged = topics.envelope(topics.tagged(feed), F.current_timestamp())
    assert drain(tagged).where("type = 'user_event'").count() == feed_size(spark)
    out = str(tmp_path / "out")
    sent = topics.write_topic(adapters.user_events_of(spark.readStream.schema(adapters.SCHEMAS["events"]).parquet(f"{SF}/events.parquet*")),
                              "alerts", str(tmp_path / "cp"), "userId", "json", path=out)
    sent.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(out).count() == adapters.table(spark, SF, "events").count()


def feed_size(spark):
    k = F.get_json_object("props", "$.k").cast("int")
    return adapters.table(spark, SF, "events").where(k > 0).count()


def test_both_outputs_of_a_batch(spark, feed, tmp_path):
    table, stream = feed
    main, side = str(tmp_path / "main"), str(tmp_path / "side")
    write = routing.split_stream(
        F.col("amount") > 500, "HIGH_AMOUNT",
        lambda df, n: df.write.mode("overwrite").parquet(f"{main}/batch={n}"),
        lambda df, n: df.write.mode("overwrite").parquet(f"{side}/batch={n}"))
    query = (adapters.transactions_of(stream()).writeStream.foreachBatch(write)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    tx = adapters.transactions_of(table)
    assert spark.read.parquet(side).count() == tx.where("amount > 500").count()
    assert spark.read.parquet(main).count() == tx.where("amount <= 500").count()
