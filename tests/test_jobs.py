"""The jobs of several topics, from messages in files to their streams, against the same operators on tables."""

import pytest
from pyspark.sql import functions as F

from builders import SF, at
from tidemark.operators import joins, keyed, metrics
from tidemark.sources import adapters, parse, topics
from tidemark.streaming import jobs

DELAY = "400 days"
NAMES = ["user-events", "transaction-events", "iot-sensor-events"]


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """(table, stream) of the messages of all topics; the last message of each topic lies far ahead."""
    root = str(tmp_path_factory.mktemp("messages"))
    made = (adapters.user_messages(spark, SF).unionByName(adapters.transaction_messages(spark, SF))
            .unionByName(adapters.sensor_messages(spark, SF)))
    columns = made.columns
    far = [("user-events", '{"userId": "zz", "sessionId": "s", "eventType": "end", "timestamp": "2030-01-01T00:00:00Z"}'),
           ("transaction-events", '{"transactionId": "zz", "userId": "zz", "amount": 1, "currency": "EUR", "status": "completed", '
                                  '"timestamp": "2030-01-01T00:00:00Z"}'),
           ("iot-sensor-events", '{"sensorId": "zz", "sensorType": "zz", "value": 1, "unit": "x", "location": "zz", '
                                 '"timestamp": "2030-01-01T00:00:00Z"}')]
    last = spark.createDataFrame([(t, 0, -1 - i, None, v) for i, (t, v) in enumerate(far)], topics.MESSAGE)
    old = spark.createDataFrame([("user-events", 0, -9, None, '{"user_id": "older", "timestamp": 1704067200000}')], topics.MESSAGE)
    made.unionByName(old, allowMissingColumns=True).select(*columns).coalesce(2).write.mode("append").parquet(root)
    last.unionByName(made.limit(0), allowMissingColumns=True).select(*columns).coalesce(1).write.mode("append").parquet(root)
    table = spark.read.schema(topics.MESSAGE).parquet(root)
    return table, lambda: topics.read_topics(spark, NAMES, "parquet", root)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect() if "zz" not in map(str, r)), key=repr)


def drained(spark, tmp_path, df, name):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def parsed(table):
    values = jobs._values(table)
    kinds = {n: values.where(F.col("messageId").startswith(n)) for n in NAMES}
    return (parse.parse_user_events(kinds[NAMES[0]]).where("ts IS NOT NULL"), parse.parse_transactions(kinds[NAMES[1]]),
            parse.parse_sensors(kinds[NAMES[2]]))


def test_stream_patterns(spark, feed, tmp_path):
    table, stream = feed
    events, tx, readings = parsed(table)
    streams = jobs.stream_patterns(stream(), DELAY, high=500, velocity_window="10 days", velocity_more_than=2)
    assert set(streams) == {"enriched_transactions", "rapid_transactions", "located_transactions", "sensor_aggregates", "processed",
                            "anomalies", "evolved_events", "limited_transactions"}

    def got(name):
        return drained(spark, tmp_path, streams[name], f"sp_{name}")

    enriched = joins.asof_join(tx, events, "userId", "event", "messageId")
    names = ("transactionId", "event.messageId", "metadata", "event.ts", "event.additionalData")
    assert rows(enriched, *names) == rows(got("enriched_transactions"), *names) != []
    assert enriched.where("size(event.additionalData) > 0").count() > 0
    placed = joins.asof_join(tx.where("location IS NOT NULL"), readings, "location", "reading", "messageId")
    names = ("transactionId", "location", "reading.messageId", "reading.value")
    assert rows(placed, *names) == rows(got("located_transactions"), *names) != []
    rapid = keyed.velocity_count(tx, "10 days", 2)
    assert rows(rapid, "transactionId", "transactionCount") == rows(got("rapid_transactions"), "transactionId", "transactionCount") != []
    large = rows(got("anomalies").where("anomalyType = 'HIGH_AMOUNT'"), "transactionId")
    assert large == rows(tx.where("amount > 500"), "transactionId") != []
    assert rows(got("processed"), "transactionId") == rows(tx.where("amount <= 500"), "transactionId") != []
    evolved = got("evolved_events")
    old = evolved.where("userId = 'older'").collect()
    assert [(r.region, r.schemaVersion, r.timestamp) for r in old] == [("unknown", "2.0", at(0).replace(tzinfo=None))]
    assert evolved.count() == table.where("topic = 'user-events'").count()


def test_tuned_processing(spark, feed, tmp_path):
    table, stream = feed
    events, tx, readings = parsed(table)
    profiles = spark.createDataFrame([("user_1", "gold")], "userId STRING, tier STRING")
    streams = jobs.tuned_processing(stream(), profiles, {"tier": "standard"}, DELAY, 20, "1 day")

    def got(name):
        return drained(spark, tmp_path, streams[name], f"tp_{name}")

    looked = joins.lookup(tx, profiles, "userId", {"tier": "standard"})
    assert rows(got("profiled_transactions"), "transactionId", "tier") == rows(looked, "transactionId", "tier") != []
    numbered = events.withColumn("eventId", F.xxhash64("messageId"))
    firsts = keyed.running_stats(numbered, "eventType").groupBy("userId").count().withColumn("count", F.col("count").cast("long"))
    assert rows(got("user_statistics").groupBy("userId").count(), "userId", "count") == rows(firsts, "userId", "count") != []
    summaries, _ = keyed.count_batches(readings.withColumn("readingId", F.xxhash64("messageId")), 20, partial=False)
    names = ("sensorType", "batch", "batchSize")
    assert rows(got("sensor_batches").where("kind = 'summary'"), *names) == rows(summaries, *names) != []
    merged = metrics.merged_latency(got("latency_sketches"), ["kind"])
    want = {"user": events.where("userId <> 'zz'").count(), "transaction": tx.where("userId <> 'zz'").count(),
            "iot": readings.where("sensorId <> 'zz'").count()}
    assert {r.kind: r.processed for r in merged.collect()} == want
