"""Keyed operators over whole tables. Limits are scaled to the data: a user acts every seven hours or so."""

from pyspark.sql import functions as F

from tidemark.operators import keyed as K
from tidemark.plans.registry import query
from tidemark.sources.adapters import sensors, transactions, user_events


@query("t1_sessions", """
WITH flagged AS (
  SELECT *, lag(ts) OVER w AS pts, lag("sessionId") OVER w AS psid FROM user_events
  WINDOW w AS (PARTITION BY "userId" ORDER BY ts, "eventId")),
numbered AS (
  SELECT *, sum(CASE WHEN pts IS NULL OR psid IS DISTINCT FROM "sessionId" OR ts - pts >= INTERVAL 3 hour
    THEN 1 ELSE 0 END) OVER (PARTITION BY "userId" ORDER BY ts, "eventId") AS n FROM flagged),
runs AS (
  SELECT "userId", n, min("sessionId") AS sid, min(ts) AS s, max(ts) AS e, count(*) AS c
  FROM numbered GROUP BY "userId", n),
followed AS (SELECT *, lead(s) OVER (PARTITION BY "userId" ORDER BY n) AS ns FROM runs)
SELECT "userId", sid AS "sessionId", s AS "sessionStart", e AS "sessionEnd",
  epoch_us(e) // 1000 - epoch_us(s) // 1000 AS duration, CAST(c AS INT) AS "eventCount",
  CASE WHEN ns - e >= INTERVAL 3 hour THEN 'timeout' WHEN ns IS NOT NULL THEN 'ended'
    WHEN e + INTERVAL 3 hour <= (SELECT max(ts) - INTERVAL 10 second FROM user_events) THEN 'timeout'
    ELSE 'active' END AS status
FROM followed
""")
def t1_sessions(spark, folder):
    return K.sessions(user_events(spark, folder), "3 hours")


@query("t1b_gap_sessions", """
WITH flagged AS (
  SELECT *, lag(ts) OVER (PARTITION BY "userId" ORDER BY ts) AS pts FROM user_events),
numbered AS (
  SELECT *, sum(CASE WHEN pts IS NULL OR ts - pts > INTERVAL 3 hour THEN 1 ELSE 0 END)
    OVER (PARTITION BY "userId" ORDER BY ts) AS n FROM flagged)
SELECT "userId", min(ts) AS window_start, max(ts) + INTERVAL 3 hour AS window_end, count(*) AS "eventCount"
FROM numbered GROUP BY "userId", n
""")
def t1b_gap_sessions(spark, folder):
    return K.gap_sessions(user_events(spark, folder), "userId", "3 hours")


@query("t2_zscore", """
WITH s AS (
  SELECT *, count(*) OVER w AS readings, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std FROM sensors
  WINDOW w AS (PARTITION BY "sensorId" ORDER BY ts, "readingId" ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT "readingId", "sensorId", "sensorType", location, ts, value, "batteryLevel", "isAnomaly", readings,
  round(mean, 6) AS mean, round(abs(value - mean) / std, 6) AS "zScore",
  round(least(0.9, abs(value - mean) / std / 2.5), 6) AS severity
FROM s WHERE readings >= 10 AND std > 0 AND abs(value - mean) / std > 2.5
""")
def t2_zscore(spark, folder):
    return K.zscore_alerts(sensors(spark, folder))


@query("t3_rapid_change", """
WITH s AS (
  SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM sensors
  WINDOW w AS (PARTITION BY "sensorId" ORDER BY ts, "readingId")),
r AS (SELECT *, CASE WHEN pv <> 0 THEN abs(value - pv) / abs(pv)
    WHEN pv = 0 AND value <> 0 THEN CAST('Infinity' AS DOUBLE) END AS rel FROM s
  WHERE ts > pts AND ts - pts < INTERVAL 2 hour)
SELECT "readingId", "sensorId", "sensorType", location, ts, value, "batteryLevel", "isAnomaly",
  pv AS "previousValue", round(rel, 6) AS "relativeChange",
  round((epoch_us(ts) - epoch_us(pts)) / 1000000.0, 6) AS seconds, round(least(0.9, rel), 6) AS severity
FROM r WHERE rel > 0.5
""")
def t3_rapid_change(spark, folder):
    return K.rapid_change(sensors(spark, folder), "2 hours")


@query("t4_data_gaps", """
WITH s AS (
  SELECT *, lag(ts) OVER (PARTITION BY "sensorId" ORDER BY ts, "readingId") AS pts FROM sensors)
SELECT "readingId", "sensorId", "sensorType", location, ts, value, "batteryLevel", "isAnomaly",
  round((epoch_us(ts) - epoch_us(pts)) / 60000000.0, 1) AS minutes, CAST(0.7 AS DOUBLE) AS severity
FROM s WHERE ts - pts > INTERVAL 8 hour
""")
def t4_data_gaps(spark, folder):
    return K.data_gaps(sensors(spark, folder), "8 hours").withColumn("minutes", F.round("minutes", 1))


@query("t5_offline", """
WITH s AS (
  SELECT *, lead(ts) OVER (PARTITION BY "sensorId" ORDER BY ts, "readingId") AS nts FROM sensors)
SELECT "sensorId", "readingId", ts AS "lastSeen", ts + INTERVAL 8 hour AS ts, CAST(0.8 AS DOUBLE) AS severity
FROM s WHERE nts - ts > INTERVAL 8 hour
  OR (nts IS NULL AND ts + INTERVAL 8 hour <= (SELECT max(ts) - INTERVAL 10 second FROM sensors))
""")
def t5_offline(spark, folder):
    return K.offline(sensors(spark, folder), "8 hours")


@query("t6_velocity_count", """
WITH c AS (
  SELECT *, count(*) OVER (PARTITION BY "userId" ORDER BY ts RANGE BETWEEN INTERVAL 1 day PRECEDING
    AND CURRENT ROW) AS n FROM transactions)
SELECT "transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud", n AS "transactionCount" FROM c WHERE n > 5
""")
def t6_velocity_count(spark, folder):
    return K.velocity_count(transactions(spark, folder), "1 day")


@query("t7_rate_limit", """
WITH c AS (
  SELECT *, row_number() OVER (PARTITION BY "userId", date_trunc('day', ts) ORDER BY ts, "transactionId") AS n
  FROM transactions)
SELECT "transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud" FROM c WHERE n <= 3
""")
def t7_rate_limit(spark, folder):
    return K.rate_limit(transactions(spark, folder), "day", 3)


@query("t8_running_stats", """
SELECT *, coalesce(epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY "userId" ORDER BY ts, "eventId")) // 1000, 0)
    AS "lastProcessingInterval",
  row_number() OVER (PARTITION BY "userId", "eventType" ORDER BY ts, "eventId") AS "eventTypeCount"
FROM user_events
""")
def t8_running_stats(spark, folder):
    return K.running_stats(user_events(spark, folder), "eventType")


@query("t9_dedupe", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY "sessionId" ORDER BY ts, "eventId") AS n FROM user_events)
SELECT * EXCLUDE (n) FROM r WHERE n = 1
""")
def t9_dedupe(spark, folder):
    return K.dedupe(user_events(spark, folder), "sessionId", ["ts", "eventId"])


BATCHES_SQL = """
WITH b AS (
  SELECT *, (row_number() OVER (PARTITION BY "sensorType" ORDER BY ts, "readingId") - 1) // 100 AS batch
  FROM sensors)
"""


@query("t10_batch_summaries", BATCHES_SQL + """
SELECT "sensorType", CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INT) AS "batchSize",
  round(avg(value), 6) AS "averageValue"
FROM b GROUP BY "sensorType", batch
""")
def t10_batch_summaries(spark, folder):
    return K.count_batches(sensors(spark, folder))[0]


@query("t10_batch_rows", BATCHES_SQL + """
, sized AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM b WINDOW w AS (PARTITION BY "sensorType", batch))
SELECT "readingId", "sensorId", "sensorType", location, ts, value, "batteryLevel", "isAnomaly",
  CAST(batch AS BIGINT) AS batch, CAST(n AS INT) AS "batchSize", round(m, 6) AS "batchAverage"
FROM sized WHERE n = 100
""")
def t10_batch_rows(spark, folder):
    return K.count_batches(sensors(spark, folder), partial=False)[1]


@query("t10_batch_rows_all", BATCHES_SQL + """
, sized AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM b WINDOW w AS (PARTITION BY "sensorType", batch))
SELECT "readingId", "sensorType", CAST(batch AS BIGINT) AS batch, CAST(n AS INT) AS "batchSize", round(m, 6) AS "batchAverage"
FROM sized
""")
def t10_batch_rows_all(spark, folder):
    """With the readings of the last, partial batch of each type."""
    rows = K.count_batches(sensors(spark, folder))[1]
    return rows.select("readingId", "sensorType", "batch", "batchSize", "batchAverage")
