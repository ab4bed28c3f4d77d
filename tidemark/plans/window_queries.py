"""Window aggregations over whole tables. Windows are wider than the defaults: users act every few hours here."""

from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.plans.registry import query
from tidemark.sources.adapters import sensors, transactions, user_events


@query("a1_user_type_counts", """
SELECT "userId" || ':' || "eventType" AS key, "userId", "eventType", count(*) AS count,
  time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 day AS window_end
FROM user_events GROUP BY ALL
""")
def a1_user_type_counts(spark, folder):
    return W.count_by_user_type(user_events(spark, folder), "1 day")


@query("a1_user_type_counts_minute", """
SELECT "userId" || ':' || "eventType" AS key, "userId", "eventType", count(*) AS count,
  time_bucket(INTERVAL 1 minute, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 1 minute, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 minute AS window_end
FROM user_events GROUP BY ALL
""")
def a1_user_type_counts_minute(spark, folder):
    return W.count_by_user_type(user_events(spark, folder))


@query("a2_page_stats", """
SELECT page, count(*) AS "pageViews", count(DISTINCT "userId") AS "uniqueUsers",
  round(coalesce(avg(duration), 0.0), 6) AS "avgDuration",
  time_bucket(INTERVAL 6 hour, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 6 hour, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 hour AS window_end
FROM user_events WHERE page IS NOT NULL
GROUP BY page, window_start, window_end
""")
def a2_page_stats(spark, folder):
    return W.page_stats(user_events(spark, folder), "6 hours")


@query("a3_event_rate", """
SELECT count(*) AS "totalEvents", CAST(count(*) // 10 AS BIGINT) AS "eventsPerSecond",
  time_bucket(INTERVAL 10 second, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 10 second, ts, TIMESTAMP '1970-01-01') + INTERVAL 10 second AS window_end
FROM user_events GROUP BY window_start, window_end
""")
def a3_event_rate(spark, folder):
    return W.event_rate(user_events(spark, folder))


@query("a4_sensor_stats", """
SELECT "sensorType", time_bucket(INTERVAL 6 hour, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 6 hour, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 hour AS window_end,
  count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS average, min(value) AS minimum,
  'tumbling_6h' AS "aggregationType"
FROM sensors GROUP BY "sensorType", window_start, window_end
""")
def a4_sensor_stats(spark, folder):
    return W.sensor_stats(sensors(spark, folder), "6 hours", "tumbling_6h")


TREND_SQL = """
WITH starts AS (
  SELECT DISTINCT time_bucket(INTERVAL 2 hour, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 2 hour AS window_start
  FROM sensors, (SELECT unnest(range(0, 5)) AS i)),
placed AS (
  SELECT "sensorType", window_start, value,
    row_number() OVER (PARTITION BY "sensorType", window_start ORDER BY ts, "readingId") - 1 AS i
  FROM starts JOIN sensors ON ts >= window_start AND ts < window_start + INTERVAL 10 hour),
fitted AS (
  SELECT "sensorType", window_start, count(*) AS n, regr_slope(value, i) AS trend
  FROM placed GROUP BY "sensorType", window_start HAVING count(*) >= 2)
SELECT "sensorType", window_start, window_start + INTERVAL 10 hour AS window_end,
  CAST(n AS INT) AS "dataPoints", round(trend, 6) AS trend,
  CASE WHEN trend > 0 THEN 'INCREASING' WHEN trend < 0 THEN 'DECREASING' ELSE 'STABLE' END AS "trendDirection",
  'sliding_10h_2h' AS "aggregationType"
FROM fitted
"""


@query("a5_sensor_trend", TREND_SQL)
def a5_sensor_trend(spark, folder):
    return W.sensor_trend(sensors(spark, folder), "10 hours", "2 hours", "sliding_10h_2h", "30 minutes")


@query("a6_cross_sensor_deviation", """
WITH groups AS (
  SELECT *, time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') AS window_start,
    count(*) OVER g AS readings, avg(value) OVER g AS mean
  FROM sensors WHERE "sensorType" = 'temperature'
  WINDOW g AS (PARTITION BY location, time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01'))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY location, window_start
    ORDER BY round(abs(value - mean), 9) DESC, "sensorId", "readingId") AS r FROM groups)
SELECT location, "sensorType", window_start, window_start + INTERVAL 1 day AS window_end, readings,
  round(mean, 6) AS mean, round(abs(value - mean), 6) AS deviation, "sensorId", "readingId", value, ts,
  round(least(0.9, abs(value - mean) / 10), 6) AS severity
FROM ranked WHERE r = 1 AND readings >= 2 AND abs(value - mean) > 5
""")
def a6_cross_sensor_deviation(spark, folder):
    return W.deviation_candidates(sensors(spark, folder), "1 day")


KINDS_SQL = """kinds AS (
  SELECT 'user' AS kind, ts, false AS f, false AS a FROM user_events
  UNION ALL SELECT 'transaction', ts, "isFraud", false FROM transactions
  UNION ALL SELECT 'iot', ts, false, "isAnomaly" FROM sensors)"""


def all_kinds(spark, folder):
    return W.all_kinds(user_events(spark, folder), transactions(spark, folder), sensors(spark, folder))


@query("a7_topic_stats", """
WITH m AS (
  SELECT time_bucket(INTERVAL 10 second, ts, TIMESTAMP '1970-01-01') AS window_start,
    "eventType" AS topic, count(*) AS messages
  FROM user_events GROUP BY ALL)
SELECT topic, messages, window_start, window_start + INTERVAL 10 second AS window_end,
  CAST(sum(messages) OVER w AS BIGINT) AS "totalMessages",
  round(sum(messages) OVER w / 10.0, 1) AS "messagesPerSecond"
FROM m WINDOW w AS (PARTITION BY window_start)
""")
def a7_topic_stats(spark, folder):
    return W.topic_stats(user_events(spark, folder).withColumnRenamed("eventType", "topic"))


@query("a8_rate_series", f"""
WITH {KINDS_SQL}
SELECT time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 hour AS window_end,
  round(count(*) / 3600.0, 2) AS "eventsPerSecond",
  round(coalesce(100.0 * count(*) FILTER (WHERE f)
    / nullif(count(*) FILTER (WHERE kind = 'transaction'), 0), 0.0), 2) AS "fraudRate"
FROM kinds GROUP BY window_start, window_end ORDER BY window_start DESC LIMIT 60
""")
def a8_rate_series(spark, folder):
    return W.rate_series(all_kinds(spark, folder), "1 hour")


@query("a9_sensor_series", """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY location, "sensorType" ORDER BY ts DESC, "readingId" DESC) AS p
  FROM sensors)
SELECT location || '_' || "sensorType" AS series, CAST(p AS INT) AS position, ts, value, "sensorId" AS label
FROM r WHERE p <= 100
""")
def a9_sensor_series(spark, folder):
    return W.sensor_series(sensors(spark, folder))


@query("a10_running_counters", f"""
WITH {KINDS_SQL}
SELECT count(*) FILTER (WHERE kind = 'user') AS "userEvents",
  count(*) FILTER (WHERE kind = 'transaction') AS transactions,
  count(*) FILTER (WHERE kind = 'iot') AS "iotEvents", count(*) FILTER (WHERE f) AS frauds,
  count(*) FILTER (WHERE a) AS anomalies, count(*) AS total,
  round(100.0 * count(*) FILTER (WHERE f) / count(*) FILTER (WHERE kind = 'transaction'), 1) AS "fraudRate"
FROM kinds
""")
def a10_running_counters(spark, folder):
    return W.running_counters(all_kinds(spark, folder))


@query("a11_throughput_status", """
WITH m AS (
  SELECT "eventType" AS topic, time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS window_start,
    count(*) AS messages
  FROM user_events GROUP BY ALL)
SELECT topic, messages, window_start, window_start + INTERVAL 1 hour AS window_end,
  CASE WHEN messages > 5 THEN 'active' WHEN messages > 2 THEN 'warning' ELSE 'inactive' END AS status
FROM m
""")
def a11_throughput_status(spark, folder):
    stats = W.topic_stats(user_events(spark, folder).withColumnRenamed("eventType", "topic"), "1 hour")
    return W.throughput_status(stats.select("topic", "messages", "window_start", "window_end"), "messages", 5, 2)
