"""As-of joins and lookups over whole tables."""

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import joins as J
from tidemark.plans.registry import query
from tidemark.sources import parse as P
from tidemark.sources.adapters import sensor_messages, sensors, table, transaction_messages, transactions, user_events

_TX = """t."transactionId", t."userId", t.ts, t.amount, t.status"""


@query("j1_asof_user_event", f"""
SELECT {_TX}, u."eventId" AS "lastEventId", u."eventType" AS "lastEventType", u.ts AS "lastEventTs"
FROM transactions t ASOF JOIN (SELECT * FROM user_events WHERE "eventType" <> 'purchase') u
  ON t."userId" = u."userId" AND t.ts >= u.ts
""")
def j1_asof_user_event(spark, folder):
    users = user_events(spark, folder).where("eventType <> 'purchase'")
    out = J.asof_join(transactions(spark, folder), users, "userId", "u", "eventId")
    return out.select("transactionId", "userId", "ts", "amount", "status", F.col("u.eventId").alias("lastEventId"),
                      F.col("u.eventType").alias("lastEventType"), F.col("u.ts").alias("lastEventTs"))


@query("j1_asof_left_tolerance", f"""
SELECT {_TX}, CASE WHEN t.ts - u.ts <= INTERVAL 3 hour THEN u."eventId" END AS "lastEventId"
FROM transactions t ASOF LEFT JOIN (SELECT * FROM user_events WHERE "eventType" = 'signup') u
  ON t."userId" = u."userId" AND t.ts >= u.ts
""")
def j1_asof_left_tolerance(spark, folder):
    users = user_events(spark, folder).where("eventType = 'signup'")
    out = J.asof_join(transactions(spark, folder), users, "userId", "u", "eventId", tolerance="3 hours", how="left")
    return out.select("transactionId", "userId", "ts", "amount", "status", F.col("u.eventId").alias("lastEventId"))


@query("j2_asof_sensor", """
WITH placed AS (
  SELECT t.*, (['warehouse_a', 'warehouse_b', 'office_floor_1', 'office_floor_2', 'production_line_1',
    'production_line_2', 'server_room', 'loading_dock', 'cafeteria', 'parking_garage'])
    [CAST((CAST(substr("userId", 6) AS BIGINT) // 10) % 10 AS INT) + 1] AS location
  FROM transactions t),
hot AS (SELECT * FROM sensors WHERE "isAnomaly")
SELECT t."transactionId", t.location, t.ts, s."readingId", s."sensorId", s.value, s.ts AS "readingTs"
FROM placed t ASOF JOIN hot s ON t.location = s.location AND t.ts >= s.ts
""")
def j2_asof_sensor(spark, folder):
    readings = sensors(spark, folder)
    place = readings.select(F.concat(F.lit("tx_"), F.col("readingId")).alias("transactionId"), "ts", "location")
    out = J.asof_join(place, readings.where("isAnomaly"), "location", "s", "readingId")
    return out.select("transactionId", "location", "ts", "s.readingId", "s.sensorId", "s.value",
                      F.col("s.ts").alias("readingTs"))


@query("j2_asof_messages", """
WITH told AS (SELECT event_id, k, CASE WHEN k % 2 = 1 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) ELSE ts END AS said FROM ev),
tx AS (SELECT t."transactionId", t.amount, e.said AS ts, (['warehouse_a', 'warehouse_b', 'office_floor_1', 'office_floor_2',
    'production_line_1', 'production_line_2', 'server_room', 'loading_dock', 'cafeteria', 'parking_garage'])
    [CAST((CAST(substr(t."userId", 6) AS BIGINT) // 10) % 10 AS INT) + 1] AS location
  FROM told e JOIN transactions t ON t."transactionId" = 'tx_' || e.event_id WHERE k > 1),
found AS (SELECT e.event_id AS id, e.said AS ts, s.location, s.value FROM told e JOIN sensors s ON s."readingId" = e.event_id
  WHERE k > 1 AND s."isAnomaly"),
met AS (SELECT t."transactionId", t.location, t.ts, t.amount, max({'ts': f.ts, 'id': f.id}) AS last
  FROM tx t JOIN found f ON t.location = f.location AND f.ts <= t.ts GROUP BY ALL)
SELECT "transactionId", met.location, met.ts, amount, id AS "readingMessage", value, found.ts AS "readingTs"
FROM met JOIN found ON met.last.id = found.id
""")
def j2_asof_messages(spark, folder):
    """Transactions as they come from their topic, by the place they name, with the last anomalous reading there."""
    tx = P.parse_transactions(transaction_messages(spark, folder).select("value"))
    readings = P.parse_sensors(sensor_messages(spark, folder).select("offset", "value")).where("isAnomaly")
    out = J.asof_join(tx.where("location IS NOT NULL"), readings, "location", "s", "offset")
    return out.select("transactionId", "location", "ts", "amount", F.col("s.offset").alias("readingMessage"), "s.value",
                      F.col("s.ts").alias("readingTs"))


@query("j3_profile_lookup", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, coalesce(c.c_mktsegment, 'premium') AS tier,
  round(coalesce(c.c_acctbal, 0.0), 6) AS balance
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
""")
def j3_profile_lookup(spark, folder):
    profiles = table(spark, folder, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tier"), F.col("c_acctbal").alias("balance"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.lookup(orders, profiles, "o_custkey", {"tier": "premium", "balance": 0.0})


@query("j1_asof_all_events", """
SELECT t."transactionId", t."userId", t.ts, max({'ts': u.ts, 'id': u."eventId"}).id AS "lastEventId"
FROM transactions t JOIN user_events u ON t."userId" = u."userId" AND u.ts <= t.ts GROUP BY t."transactionId", t."userId", t.ts
""")
def j1_asof_all_events(spark, folder):
    """Every event counts; of several at one instant the one of largest id is the latest."""
    out = J.asof_join(transactions(spark, folder), user_events(spark, folder), "userId", "u", "eventId")
    return out.select("transactionId", "userId", "ts", F.col("u.eventId").alias("lastEventId"))


@query("j2_asof_all_readings", """
SELECT p."readingId" AS "placeId", p.location, p.ts, max({'ts': s.ts, 'id': s."readingId"}).id AS "readingId"
FROM sensors p JOIN sensors s ON p.location = s.location AND s.ts <= p.ts GROUP BY p."readingId", p.location, p.ts
""")
def j2_asof_all_readings(spark, folder):
    readings = sensors(spark, folder)
    place = readings.select(F.col("readingId").alias("placeId"), "ts", "location")
    return J.asof_join(place, readings, "location", "s", "readingId").select("placeId", "location", "ts", "s.readingId")


@query("j3_all_customers", """
SELECT o.o_orderkey, o.o_custkey, coalesce(c.c_mktsegment, 'premium') AS tier, round(coalesce(c.c_acctbal, 0.0), 6) AS balance
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def j3_all_customers(spark, folder):
    profiles = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tier"), F.col("c_acctbal").alias("balance"))
    return J.lookup(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), profiles, "o_custkey",
                    {"tier": "premium", "balance": 0.0})


@query("j4_reference_lookup", """
WITH limits AS (SELECT * FROM (VALUES
  ('grocery', 15.0, 200.0), ('gas_station', 20.0, 80.0), ('restaurant', 10.0, 150.0), ('retail', 25.0, 500.0),
  ('online', 5.0, 1000.0), ('atm', 20.0, 400.0), ('hotel', 80.0, 400.0), ('airline', 150.0, 1500.0),
  ('pharmacy', 5.0, 100.0), ('electronics', 50.0, 2000.0)) AS v(c, lo, hi))
SELECT "transactionId", "merchantCategory", amount, CAST(lo AS DOUBLE) AS "usualMin", CAST(hi AS DOUBLE) AS "usualMax",
  amount BETWEEN lo AND hi AS usual
FROM transactions LEFT JOIN limits ON "merchantCategory" = c
""")
def j4_reference_lookup(spark, folder):
    tx = transactions(spark, folder).select("transactionId", "merchantCategory", "amount")
    out = J.lookup(tx, scoring.merchant_limits(spark), "merchantCategory", small=True)
    return out.drop("fraudMultiplier").withColumn("usual", F.col("amount").between(F.col("usualMin"), F.col("usualMax")))
