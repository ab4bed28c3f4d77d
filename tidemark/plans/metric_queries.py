"""Metric series made from the events: per user a counter that grows and sometimes restarts."""

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.plans.registry import query
from tidemark.sources.adapters import sensors, transactions

_LAG = 'PARTITION BY "sensorId" ORDER BY ts'


def _counters(spark, folder):
    return sensors(spark, folder).select("sensorId", "location", "ts", F.col("batteryLevel").cast("double").alias("total"))


_COUNTERS = """counters AS (SELECT "sensorId", location, ts, CAST("batteryLevel" AS DOUBLE) AS total FROM sensors)"""


@query("m1_counter_rate", f"""
WITH {_COUNTERS},
d AS (SELECT *, CASE WHEN total < lag(total) OVER w THEN total ELSE total - lag(total) OVER w END AS inc
  FROM counters WINDOW w AS ({_LAG})),
pairs AS (
  SELECT a."sensorId", a.location, a.ts, a.total, b.ts AS bts, b.inc,
    min(b.ts) OVER (PARTITION BY a."sensorId", a.ts) AS first_ts
  FROM d a JOIN d b ON a."sensorId" = b."sensorId" AND b.ts BETWEEN a.ts - INTERVAL 1 day AND a.ts)
SELECT "sensorId", location, ts, total,
  round(CASE WHEN min(first_ts) < ts THEN sum(CASE WHEN bts > first_ts THEN inc ELSE 0 END)
    / ((epoch_us(ts) - epoch_us(min(first_ts))) / 1000000.0) END, 6) AS rate
FROM pairs GROUP BY "sensorId", location, ts, total
""")
def m1_counter_rate(spark, folder):
    return M.counter_rate(_counters(spark, folder), ["sensorId"], "ts", "total", "1 day")


@query("m2_instant_rate", f"""
WITH {_COUNTERS},
d AS (SELECT *, lag(ts) OVER w AS pts, lag(total) OVER w AS pt FROM counters WINDOW w AS ({_LAG}))
SELECT "sensorId", location, ts, total, round(CASE WHEN total < pt THEN total ELSE total - pt END
  / ((epoch_us(ts) - epoch_us(pts)) / 1000000.0), 6) AS irate FROM d
""")
def m2_instant_rate(spark, folder):
    return M.instant_rate(_counters(spark, folder), ["sensorId"], "ts", "total")


@query("m2_utilisation", f"""
WITH {_COUNTERS},
d AS (SELECT *, lag(ts) OVER w AS pts, lag(total) OVER w AS pt FROM counters WINDOW w AS ({_LAG})),
r AS (SELECT location, time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') AS window_start,
  CASE WHEN total < pt THEN total ELSE total - pt END / ((epoch_us(ts) - epoch_us(pts)) / 1000000.0) AS irate FROM d
  WHERE pt IS NOT NULL)
SELECT location, window_start, window_start + INTERVAL 1 day AS window_end, round(100 - avg(irate) * 100, 6) AS utilisation
FROM r GROUP BY location, window_start
""")
def m2_utilisation(spark, folder):
    return M.utilisation(_counters(spark, folder), "location", ["sensorId"], "ts", "total", "1 day")


@query("m3_ratio", """
SELECT "sensorId", ts, round((1 - "batteryLevel" / nullif(value, 0)) * 100, 6) AS used FROM sensors
""")
def m3_ratio(spark, folder):
    return sensors(spark, folder).select("sensorId", "ts", M.ratio(F.col("batteryLevel"), F.col("value")).alias("used"))


@query("m4_sustained", """
WITH c AS (SELECT *, "batteryLevel" > 30 AS hot FROM sensors),
f AS (SELECT *, CASE WHEN hot IS DISTINCT FROM lag(hot) OVER (PARTITION BY "sensorId" ORDER BY ts, "readingId")
  THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY "sensorId" ORDER BY ts, "readingId") AS n FROM f)
SELECT "sensorId", min(ts) AS "start", max(ts) AS "end", count(*) AS samples FROM g WHERE hot GROUP BY "sensorId", n
HAVING max(ts) - min(ts) >= INTERVAL 12 hour
""")
def m4_sustained(spark, folder):
    return M.sustained(sensors(spark, folder), ["sensorId"], "ts", F.col("batteryLevel") > 30, "12 hours", "readingId")


@query("m5_latency", """
SELECT status, count(*) AS processed, CAST(quantile_disc(l, 0.5) AS BIGINT) AS p50,
  CAST(quantile_disc(l, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(l, 0.99) AS BIGINT) AS p99
FROM (SELECT status, CAST(floor(amount) AS BIGINT) AS l FROM transactions) GROUP BY status
""")
def m5_latency(spark, folder):
    rows = transactions(spark, folder).select("status", F.floor("amount").alias("latency"))
    return M.latency_histogram(rows, "status", "latency")


@query("m5_latency_sketches", """
SELECT status, count(*) AS processed, true AS "p50Holds", true AS "p95Holds", true AS "p99Holds" FROM transactions GROUP BY status
""")
def m5_latency_sketches(spark, folder):
    """Daily sketches merged, and whether the exact rank of each quantile keeps to three times the stated error."""
    rows = transactions(spark, folder).select("status", "ts", "amount")
    found = M.merged_latency(M.latency_sketches(rows, "status", "amount", "ts", "1 day"), ["status"])
    shares, slack = {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 3 * M.rank_error(800)
    ranked = rows.join(found, "status").groupBy("status", "processed").agg(*[
        F.avg((F.col("amount") < F.col(p)).cast("int")).alias(f"{p}_below") for p in shares], *[
        F.avg((F.col("amount") <= F.col(p)).cast("int")).alias(f"{p}_upto") for p in shares])
    return ranked.select("status", "processed", *[
        ((F.col(f"{p}_below") <= q + slack) & (F.col(f"{p}_upto") >= q - slack)).alias(f"{p}Holds") for p, q in shares.items()])
