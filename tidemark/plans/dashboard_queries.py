"""Dashboard queries over whole tables."""

from pyspark.sql import functions as F

from tidemark.operators import dashboard as B
from tidemark.plans.registry import query
from tidemark.plans.window_queries import KINDS_SQL, all_kinds
from tidemark.sources.adapters import sensors, table, transactions, user_events

_TX = """"transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud" """


@query("q1_recent", 'SELECT * FROM user_events ORDER BY ts DESC, "eventId" DESC LIMIT 10')
def q1_recent(spark, folder):
    return B.recent(user_events(spark, folder), 10, tiebreak="eventId")


@query("q1_history", 'SELECT * FROM sensors ORDER BY ts DESC, "readingId" DESC LIMIT 1000')
def q1_history(spark, folder):
    return B.recent(sensors(spark, folder), 1000, tiebreak="readingId")


def _recent_sql(view: str, column: str, last: int, tiebreak: str, where: str = "true") -> str:
    return f"""
WITH newest AS (SELECT * FROM {view} WHERE {where} ORDER BY ts DESC, "{tiebreak}" DESC LIMIT {last})
SELECT {column} AS label, count(*) AS value FROM newest GROUP BY ALL"""


@query("q2_event_types", _recent_sql("user_events", '"eventType"', 100, "eventId"))
def q2_event_types(spark, folder):
    return B.distribution(user_events(spark, folder), "eventType", 100, "eventId")


@query("q3_top_countries", _recent_sql("user_events", "country", 100, "eventId")
       + " ORDER BY value DESC, label LIMIT 10")
def q3_top_countries(spark, folder):
    return B.top(user_events(spark, folder), "country", 100, 10, "eventId")


@query("q3_top_nations_of_customers", """
SELECT n_name AS label, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY value DESC, label LIMIT 10
""")
def q3_top_nations_of_customers(spark, folder):
    # Twenty-five nations: a table of fixed size.
    nations = F.broadcast(table(spark, folder, "nation"))
    named = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return (named.groupBy(F.col("n_name").alias("label")).agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), "label").limit(10))


@query("q4_fraud_categories", _recent_sql("transactions", '"merchantCategory"', 50, "transactionId", '"isFraud"'))
def q4_fraud_categories(spark, folder):
    return B.distribution(transactions(spark, folder).where("isFraud"), "merchantCategory", 50, "transactionId")


@query("q5_anomaly_types", _recent_sql("sensors", '"sensorType"', 50, "readingId", '"isAnomaly"'))
def q5_anomaly_types(spark, folder):
    return B.distribution(sensors(spark, folder).where("isAnomaly"), "sensorType", 50, "readingId")


@query("q6_sensor_locations", _recent_sql("sensors", "replace(location, '_', ' ')", 100, "readingId"))
def q6_sensor_locations(spark, folder):
    return B.distribution(sensors(spark, folder), "location", 100, "readingId",
                          label=F.replace("location", F.lit("_"), F.lit(" ")))


@query("q7_active_users", """
WITH newest AS (SELECT * FROM user_events ORDER BY ts DESC, "eventId" DESC LIMIT 100)
SELECT count(DISTINCT "sessionId") AS "distinctValues" FROM newest
""")
def q7_active_users(spark, folder):
    return B.distinct_recent(user_events(spark, folder), "sessionId", 100, "eventId")


@query("q8_distinct_types", """
SELECT DISTINCT 'user' AS kind, "eventType" AS type FROM user_events
UNION SELECT 'transaction', status FROM transactions UNION SELECT 'iot', "sensorType" FROM sensors
""")
def q8_distinct_types(spark, folder):
    return B.distinct_types(user_events(spark, folder), transactions(spark, folder), sensors(spark, folder))


@query("q9_filter_options", """
SELECT 'eventType' AS "option", "eventType" AS value FROM user_events
UNION SELECT 'country', country FROM user_events UNION SELECT 'userId', "userId" FROM user_events
UNION SELECT 'userId', "userId" FROM transactions
""")
def q9_filter_options(spark, folder):
    return B.filter_options(user_events(spark, folder), transactions(spark, folder))


@query("q10_filter_users", """
SELECT * FROM user_events WHERE ts >= (SELECT max(ts) FROM user_events) - INTERVAL 24 hour
  AND "eventType" IN ('view', 'click') AND country IN ('US', 'DE', 'FR')
""")
def q10_filter_users(spark, folder):
    chosen = B.Filter("24h", event_types=["view", "click"], countries=["US", "DE", "FR"])
    return B.filter_users(user_events(spark, folder), chosen)


@query("q11_filter_tx", f"""
SELECT {_TX} FROM transactions WHERE ts >= (SELECT max(ts) FROM transactions) - INTERVAL 24 hour
  AND amount >= 50 AND amount <= 400
""")
def q11_filter_tx(spark, folder):
    return B.filter_tx(transactions(spark, folder), B.Filter("24h", min_amount=50, max_amount=400))


@query("q12_filter_sensors", """
SELECT * FROM sensors WHERE ts >= (SELECT max(ts) FROM sensors) - INTERVAL 24 hour
""")
def q12_filter_sensors(spark, folder):
    return B.filter_sensors(sensors(spark, folder), B.Filter("24h"))


@query("q13_preset_fraud_day", f"""
SELECT {_TX} FROM transactions WHERE ts >= (SELECT max(ts) FROM transactions) - INTERVAL 24 hour AND "isFraud"
""")
def q13_preset_fraud_day(spark, folder):
    chosen = B.replace(B.preset("fraud"), time_range="24h")
    return B.filter_tx(transactions(spark, folder), chosen)


@query("q13_preset_high_value", f"""
SELECT {_TX} FROM transactions WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 hour AND amount >= 1000
""")
def q13_preset_high_value(spark, folder):
    return B.filter_tx(transactions(spark, folder), B.preset("high-value"),
                       F.lit("2024-01-20 12:00:00").cast("timestamp"))


@query("q14_fraud_list", f"""
SELECT {_TX} FROM transactions WHERE "isFraud" ORDER BY ts DESC, "transactionId" DESC LIMIT 10
""")
def q14_fraud_list(spark, folder):
    return B.flagged(transactions(spark, folder), "isFraud", 10, "transactionId")


@query("q14_anomaly_list", 'SELECT * FROM sensors WHERE "isAnomaly" ORDER BY ts DESC, "readingId" DESC LIMIT 10')
def q14_anomaly_list(spark, folder):
    return B.flagged(sensors(spark, folder), "isAnomaly", 10, "readingId")


@query("q15_share", """
SELECT "eventType", count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent
FROM user_events GROUP BY "eventType"
""")
def q15_share(spark, folder):
    counted = user_events(spark, folder).groupBy("eventType").agg(F.count(F.lit(1)).alias("n"))
    return B.share(counted, "eventType", "n")


@query("q16_freshness", """
SELECT max(ts) AS "lastUpdate", TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 5 second > max(ts) AS stale FROM user_events
""")
def q16_freshness(spark, folder):
    return B.freshness(user_events(spark, folder), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("q17_counts_by_kind", f"""
WITH {KINDS_SQL}
SELECT count(*) FILTER (WHERE kind = 'user') AS "userEvents",
  count(*) FILTER (WHERE kind = 'transaction') AS transactions,
  count(*) FILTER (WHERE kind = 'iot') AS "iotEvents", count(*) AS total FROM kinds
""")
def q17_counts_by_kind(spark, folder):
    return B.counts_by_kind(all_kinds(spark, folder))
