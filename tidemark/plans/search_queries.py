"""Document queries over whole tables."""

from pyspark.sql import functions as F

from tidemark.operators import search as X
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import documents as D
from tidemark.sources.adapters import sensors, table, transactions, user_events

_TX = """"transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud" """


@query("x1_count", "SELECT count(*) AS count FROM user_events")
def x1_count(spark, folder):
    return X.count(user_events(spark, folder))


@query("x2_term", """SELECT * FROM user_events WHERE "eventType" = 'signup'""")
def x2_term(spark, folder):
    return X.all_of(user_events(spark, folder), X.term("eventType", "signup"))


@query("x3_range_amount", f"SELECT {_TX} FROM transactions WHERE amount >= 1000")
def x3_range_amount(spark, folder):
    return X.all_of(transactions(spark, folder), X.range_("amount", gte=1000))


@query("x3_range_time", f"""
SELECT {_TX} FROM transactions WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'
""")
def x3_range_time(spark, folder):
    lo, hi = (F.lit(t).cast("timestamp") for t in ("2024-01-10 00:00:00", "2024-01-12 12:00:00"))
    return X.all_of(transactions(spark, folder), X.range_("ts", lo, hi))


@query("x4_all_of", f"""
SELECT {_TX} FROM transactions WHERE amount BETWEEN 100 AND 400 AND status = 'completed' AND country = 'US'
""")
def x4_all_of(spark, folder):
    return X.all_of(transactions(spark, folder), X.range_("amount", 100, 400), X.term("status", "completed"),
                    X.term("country", "US"))


@query("x5_terms", """
SELECT location, count(*) AS doc_count FROM sensors GROUP BY location ORDER BY doc_count DESC, location LIMIT 5
""")
def x5_terms(spark, folder):
    return X.terms_agg(sensors(spark, folder), "location", 5)


@query("x5_terms_orders", """
SELECT o_orderpriority, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY doc_count DESC, o_orderpriority LIMIT 10
""")
def x5_terms_orders(spark, folder):
    return X.terms_agg(table(spark, folder, "orders"), "o_orderpriority")


@query("x6_date_histogram", """
WITH b AS (
  SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, sum(amount) AS total FROM transactions
  WHERE "isFraud" GROUP BY 1),
every AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 hour)) AS bucket)
SELECT every.bucket, coalesce(n, 0) AS doc_count, round(total, 6) AS total FROM every LEFT JOIN b USING (bucket)
""")
def x6_date_histogram(spark, folder):
    frauds = transactions(spark, folder).where("isFraud")
    return X.date_histogram(frauds, "ts", "1 hour", {"total": F.sum("amount")})


@query("x6_orders_by_day", """
WITH b AS (SELECT date_trunc('day', o_orderdate) AS bucket, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1),
every AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 day)) AS bucket)
SELECT every.bucket, coalesce(n, 0) AS doc_count, round(total, 2) AS total FROM every LEFT JOIN b USING (bucket)
""")
def x6_orders_by_day(spark, folder):
    found = X.date_histogram(table(spark, folder, "orders"), "o_orderdate", "1 day", {"total": F.sum("o_totalprice")})
    return found.withColumn("total", F.round("total", 2))


@query("x6_all_transactions", """
WITH b AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, sum(amount) AS total FROM transactions GROUP BY 1),
every AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 hour)) AS bucket)
SELECT every.bucket, coalesce(n, 0) AS doc_count, round(total, 6) AS total FROM every LEFT JOIN b USING (bucket)
""")
def x6_all_transactions(spark, folder):
    return X.date_histogram(transactions(spark, folder), "ts", "1 hour", {"total": F.sum("amount")})


@query("x7_page", """SELECT * FROM user_events WHERE "eventId" > 299 ORDER BY "eventId" LIMIT 100""")
def x7_page(spark, folder):
    return X.page(user_events(spark, folder), "eventId", after=299, n=100)


@query("x8_across", """
SELECT "index", "userId", count(*) AS n FROM (
  SELECT 'user-events-2024' AS "index", "userId" FROM user_events
  UNION ALL SELECT 'transaction-events-2024', "userId" FROM transactions)
WHERE "userId" = 'user_7' GROUP BY ALL
""")
def x8_across(spark, folder):
    tables = {"user-events-2024": user_events(spark, folder), "transaction-events-2024": transactions(spark, folder),
              "sensors": sensors(spark, folder)}
    found = X.all_of(X.across(tables, "*-events-*"), X.term("userId", "user_7"))
    return found.groupBy("index", "userId").agg(F.count(F.lit(1)).alias("n"))


@query("x9_bulk_load", "SELECT count(*) AS sent, count(*) AS stored FROM sensors")
def x9_bulk_load(spark, folder):
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/bulk-{folder.rstrip('/').rsplit('/', 1)[-1]}"
    return D.bulk_load(sensors(spark, folder), path)


@query("x10_conform", """
SELECT CAST(NULL AS VARCHAR) AS doc_id, ts, "transactionId", "userId", amount, CAST(NULL AS VARCHAR) AS currency, status,
  country, "merchantCategory", CAST("riskScore" AS DOUBLE) AS "riskScore", "isFraud" FROM transactions
""")
def x10_conform(spark, folder):
    loose = transactions(spark, folder).withColumn("amount", F.col("amount").cast("string"))
    return D.conform(loose, "transaction-events-2024-01")


@query("x11_has_tag", """
SELECT "readingId", "sensorType", location FROM sensors WHERE "sensorType" = 'humidity' OR location = 'humidity'
""")
def x11_has_tag(spark, folder):
    tagged = sensors(spark, folder).withColumn("tags", F.array("sensorType", "location"))
    return X.all_of(tagged, X.has_tag("tags", "humidity")).select("readingId", "sensorType", "location")


@query("x12_order_violations", """
WITH s AS (SELECT "sensorId", "readingId", "batteryLevel",
  lag("batteryLevel") OVER (PARTITION BY "sensorId" ORDER BY "readingId") AS p FROM sensors)
SELECT "sensorId", "readingId", "batteryLevel", p AS "previousSeq" FROM s WHERE p > "batteryLevel"
""")
def x12_order_violations(spark, folder):
    rows = sensors(spark, folder).select("sensorId", "readingId", "batteryLevel")
    return X.order_violations(rows, "sensorId", "readingId", "batteryLevel")
