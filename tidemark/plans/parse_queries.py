"""Sources, parsing, routing and document tables over messages made from the whole events table."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators.search import all_of, term
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import documents as D
from tidemark.sources import parse as P
from tidemark.sources import topics as T
from tidemark.sources.adapters import (
    sensor_messages, sensors, table, transaction_messages, transactions, user_events, user_events_of, user_messages)

# Odd messages carry their time in milliseconds.
_TS = "CASE WHEN k % 2 = 1 THEN make_timestamp(epoch_us(e.ts) // 1000 * 1000) ELSE e.ts END"


def _narrow(messages):
    return messages.select("offset", "value")


@query("p1_parse_user_events", f"""
SELECT e.event_id AS "offset", CASE WHEN k > 1 THEN u."userId" ELSE 'unknown' END AS "userId",
  CASE WHEN k > 1 THEN u."sessionId" END AS "sessionId",
  CASE WHEN k > 1 THEN u."eventType" ELSE 'parse_error' END AS "eventType",
  CASE WHEN k > 1 THEN {_TS} END AS ts, CASE WHEN k > 1 THEN u.page END AS page,
  CASE WHEN k > 1 THEN u.country END AS country, CASE WHEN k > 1 THEN CAST(u.duration AS VARCHAR) END AS duration,
  CASE WHEN k > 1 THEN CASE WHEN u.duration IS NULL THEN 0 ELSE 1 END END AS leftover
FROM ev e JOIN user_events u ON u."eventId" = e.event_id
""")
def p1_parse_user_events(spark, folder):
    parsed = P.parse_user_events(_narrow(user_messages(spark, folder)))
    return parsed.withColumns({"duration": F.col("additionalData")["duration"],
                               "leftover": F.size("additionalData")}).drop("additionalData")


@query("p3_parse_transactions", f"""
SELECT e.event_id AS "offset", t."transactionId", t."userId", t.amount, 'USD' AS currency, t.status, {_TS} AS ts,
  CASE WHEN k = 2 THEN 0.0 ELSE k / 100.0 END :: DOUBLE AS "riskScore",
  CASE WHEN k = 3 THEN 'UNKNOWN' ELSE t.country END AS country, 'UNKNOWN' AS "merchantId",
  t."merchantCategory", t."isFraud"
FROM ev e JOIN transactions t ON t."transactionId" = 'tx_' || e.event_id WHERE k > 1
""")
def p3_parse_transactions(spark, folder):
    return P.parse_transactions(_narrow(transaction_messages(spark, folder))).select(
        "offset", "transactionId", "userId", "amount", "currency", "status", "ts", "riskScore", "country",
        "merchantId", "merchantCategory", "isFraud")


@query("p4_parse_sensors", f"""
SELECT e.event_id AS "offset", s."sensorId", s."sensorType", s.value, 'unit' AS unit, s.location, {_TS} AS ts,
  CASE WHEN k = 2 THEN 100 ELSE k END AS "batteryLevel", s."isAnomaly"
FROM ev e JOIN sensors s ON s."readingId" = e.event_id WHERE k > 1
""")
def p4_parse_sensors(spark, folder):
    return P.parse_sensors(_narrow(sensor_messages(spark, folder))).select(
        "offset", "sensorId", "sensorType", "value", "unit", "location", "ts", "batteryLevel", "isAnomaly")


@query("p5_parse_generic_envelope", """
SELECT e.event_id AS "offset", CASE WHEN k > 1 THEN t."userId" END AS "userId",
  CASE WHEN k > 0 THEN t.amount END AS amount, CASE WHEN k = 0 THEN 'Invalid JSON' END AS error,
  CASE WHEN k = 0 THEN 25 END AS "originalLength"
FROM ev e JOIN transactions t ON t."transactionId" = 'tx_' || e.event_id
""")
def p5_parse_generic_envelope(spark, folder):
    docs = P.parse_generic(_narrow(transaction_messages(spark, folder)))
    return docs.select("offset", P.field("userId").alias("userId"), P.field("amount", "double").alias("amount"),
                       "error", F.length("original").alias("originalLength"))


@query("p6_parse_generic_drop", """
SELECT e.event_id AS "offset", CASE WHEN k > 1 THEN t."userId" END AS "userId", t.amount
FROM ev e JOIN transactions t ON t."transactionId" = 'tx_' || e.event_id WHERE k > 0
""")
def p6_parse_generic_drop(spark, folder):
    docs = P.parse_generic(_narrow(transaction_messages(spark, folder)), on_error="drop")
    return docs.select("offset", P.field("userId").alias("userId"), P.field("amount", "double").alias("amount"))


@query("p8_location_key", """
SELECT coalesce(CASE WHEN "batteryLevel" >= 10 THEN location END, 'unknown') AS "locationKey", count(*) AS readings
FROM sensors GROUP BY ALL
""")
def p8_location_key(spark, folder):
    place = F.when(F.col("batteryLevel") >= 10, F.col("location"))
    return (sensors(spark, folder).groupBy(P.location_key(place).alias("locationKey"))
            .agg(F.count(F.lit(1)).alias("readings")))


@query("p9_schema_evolution", """
SELECT e.event_id AS "eventId", u."userId", '2.0' AS "schemaVersion", 'unknown' AS region,
  CASE WHEN k % 3 = 0 THEN e.ts WHEN k % 3 = 1 THEN make_timestamp(epoch_us(e.ts) // 1000 * 1000) END AS timestamp
FROM ev e JOIN user_events u ON u."eventId" = e.event_id
""")
def p9_schema_evolution(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    users = user_events_of(table(spark, folder, "events"), "props")
    old = users.select(
        "eventId", F.when(k % 2 == 0, F.col("userId")).alias("userId"),
        F.when(k % 2 == 1, F.col("userId")).alias("user_id"),
        F.when(k % 3 == 0, iso).when(k % 3 == 1, F.unix_millis("ts").cast("string"))
        .otherwise("no time").alias("timestamp"))
    return P.evolve(old, {"userId": ["user_id"]}, {"region": "unknown"})


@query("p10_p11_filters", """
SELECT "sensorType", count(*) AS readings FROM sensors
WHERE "sensorType" = 'temperature' AND location IS NOT NULL GROUP BY ALL
""")
def p10_p11_filters(spark, folder):
    kept = all_of(sensors(spark, folder), term("sensorType", "temperature"), F.col("location").isNotNull())
    return kept.groupBy("sensorType").agg(F.count(F.lit(1)).alias("readings"))


@query("p12_stamp", """
SELECT 'user-events' AS "eventSource", true AS stamped, count(*) AS n FROM user_events
""")
def p12_stamp(spark, folder):
    stamped = P.stamp(user_events(spark, folder), "user-events")
    return (stamped.groupBy("eventSource", F.col("processedAt").isNotNull().alias("stamped"))
            .agg(F.count(F.lit(1)).alias("n")))


_MESSAGES = """kinds AS (
  SELECT 'user_event' AS type, 'user-events' AS topic, k, event_id, ts FROM ev
  UNION ALL SELECT 'transaction_event', 'transaction-events', k, event_id, ts FROM ev
  UNION ALL SELECT 'iot_sensor_event', 'iot-sensor-events', k, event_id, ts FROM ev)"""


@query("s3_p14_envelopes", f"""
WITH {_MESSAGES}
SELECT type, topic, 0 AS "partition", event_id AS "offset", event_id * 10 AS timestamp, k > 0 AS "hasData"
FROM kinds WHERE k > 0 AND (SELECT count(*) FROM user_events) > 0
""")
def s3_p14_envelopes(spark, folder):
    messages = (user_messages(spark, folder).unionByName(transaction_messages(spark, folder))
                .unionByName(sensor_messages(spark, folder)))
    sent = T.envelope(T.tagged(messages), F.timestamp_millis(F.col("offset") * 10))
    return sent.withColumn("hasData", F.length("data") > 0).drop("data")


@query("s4_topic_messages", """
SELECT "userId" AS key, length('{"transactionId":"' || "transactionId" || '","userId":"' || "userId" || '"}') AS "bytes",
  "transactionId" FROM transactions
""")
def s4_topic_messages(spark, folder):
    rows = transactions(spark, folder).select("transactionId", "userId")
    sent = T.as_messages(rows, "userId")
    return sent.select("key", F.length("value").cast("bigint").alias("bytes"),
                       F.get_json_object("value", "$.transactionId").alias("transactionId"))


_DOCS = """docs AS (
  SELECT "transactionId" AS doc_id, 'transaction-events' AS "index" FROM transactions
  UNION ALL SELECT "sensorId" || '_' || strftime(ts, '%Y_%m_%d_%H_%M_%S_%f'), 'iot-sensor-events' FROM sensors
  UNION ALL SELECT "userId" || '_' || strftime(ts, '%Y_%m_%d_%H_%M_%S_%f'), 'user-events' FROM user_events)"""


@query("s7_s8_ids_and_routes", f"WITH {_DOCS} SELECT * FROM docs")
def s7_s8_ids_and_routes(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    none = F.lit(None).cast("string")
    rows = (transactions(spark, folder).select("transactionId", none.alias("sensorId"), "userId", text)
            .unionByName(sensors(spark, folder).select(none.alias("transactionId"), "sensorId", none.alias("userId"), text))
            .unionByName(user_events(spark, folder).select(
                none.alias("transactionId"), none.alias("sensorId"), "userId", text)))
    return D.route_index(D.doc_id(rows)).select("doc_id", "index")


@query("s6_document_upsert", """
WITH ranked AS (
  SELECT "userId", ts, "eventType", row_number() OVER (PARTITION BY "userId" ORDER BY ts DESC) AS r FROM user_events)
SELECT "userId" AS doc_id, ts, "eventType", 'user-events' AS "index" FROM ranked WHERE r = 1
""")
def s6_document_upsert(spark, folder):
    """Two batches, the second written twice, then read back."""
    root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/documents-{folder.rstrip('/').rsplit('/', 1)[-1]}"
    docs = D.route_index(user_events(spark, folder).select(
        F.col("userId").alias("doc_id"), "ts", "eventType", "eventId"))
    half = F.col("eventId") % 2
    schema = docs.select("doc_id", "ts", "eventType").schema
    for batch, part in ((0, half == 0), (1, half == 1), (1, half == 1)):
        D.upsert(docs.where(part).drop("eventId"), root, batch, ["ts"])
    return D.read_documents(spark, root, schema, ["ts"])


@query("s6_three_kinds_in_one_root", f"""
WITH {_DOCS} SELECT "index", count(DISTINCT doc_id) AS documents, sum(CAST(length(doc_id) AS BIGINT)) :: BIGINT AS id_chars
FROM (SELECT DISTINCT * FROM docs) GROUP BY "index"
""")
def s6_three_kinds_in_one_root(spark, folder):
    """Three writers, each counting its batches from 0, and a fold with one more batch 0 after it."""
    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/kinds-{folder.rstrip('/').rsplit('/', 1)[-1]}"
    root, folded = f"{base}-{uuid.uuid4().hex}", f"{base}-{uuid.uuid4().hex}"
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    kinds = {"tx": transactions(spark, folder).select("transactionId", "ts", text), "iot": sensors(spark, folder).select("sensorId", "ts", text),
             "user": user_events(spark, folder).select("userId", "ts", text)}
    docs = {name: D.route_index(D.doc_id(rows)).select("doc_id", "ts", "index") for name, rows in kinds.items()}
    schema = docs["tx"].select("doc_id", "ts").schema
    for name in ("tx", "iot"):
        D.upsert(docs[name], root, 0, ["ts"], writer=name)
    D.fold(spark, root, folded, schema, ["ts"])
    D.upsert(docs["user"], folded, 0, ["ts"], writer="user")
    return D.read_documents(spark, folded, schema, ["ts"]).groupBy("index").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("doc_id").cast("bigint")).alias("id_chars"))


@query("s9_retention", """
SELECT * FROM user_events WHERE ts >= (SELECT max(ts) - INTERVAL 7 day FROM user_events)
""")
def s9_retention(spark, folder):
    return D.retain(user_events(spark, folder), "ts", "7 days")


@query("s10_compaction", """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY "sensorId" ORDER BY ts DESC, "readingId" DESC) AS n FROM sensors)
SELECT * EXCLUDE (n) FROM r WHERE n = 1
""")
def s10_compaction(spark, folder):
    return D.compact_latest(sensors(spark, folder), ["sensorId"], ["ts", "readingId"])
