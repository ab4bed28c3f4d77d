"""Labels, limits and scores over whole tables."""

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.times import is_off_hours
from tidemark.operators import enrich as E
from tidemark.plans.registry import query
from tidemark.sources.adapters import sensors, transactions, user_events

_PARTS = """strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) AS INT) AS "dayOfWeek",
  CAST(month(ts) AS INT) AS month, CAST(year(ts) AS INT) AS year"""


@query("e12_enrich_user", f"""
SELECT *, {_PARTS},
  CASE WHEN lower("eventType") IN ('page_view', 'click', 'scroll') THEN 'engagement'
    WHEN lower("eventType") = 'search' THEN 'search'
    WHEN lower("eventType") IN ('add_to_cart', 'remove_from_cart', 'purchase') THEN 'commerce'
    WHEN lower("eventType") IN ('login', 'logout', 'signup') THEN 'authentication' ELSE 'other' END AS "eventCategory",
  CASE WHEN country IN ('US', 'CA', 'MX') THEN 'North America' WHEN country IN ('UK', 'DE', 'FR') THEN 'Europe'
    WHEN country = 'AU' THEN 'Oceania' WHEN country IN ('JP', 'IN') THEN 'Asia'
    WHEN country = 'BR' THEN 'South America' ELSE 'Other' END AS region,
  CASE country WHEN 'US' THEN 'America/New_York' WHEN 'UK' THEN 'Europe/London' WHEN 'DE' THEN 'Europe/Berlin'
    WHEN 'JP' THEN 'Asia/Tokyo' WHEN 'AU' THEN 'Australia/Sydney' ELSE 'UTC' END AS timezone
FROM user_events
""")
def e12_enrich_user(spark, folder):
    return E.enrich_user(user_events(spark, folder))


@query("e12_enrich_tx", f"""
SELECT "transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud", {_PARTS},
  CASE WHEN "riskScore" >= 0.8 THEN 'high' WHEN "riskScore" >= 0.5 THEN 'medium' WHEN "riskScore" >= 0.2 THEN 'low'
    ELSE 'very_low' END AS "riskCategory",
  CASE WHEN amount >= 1000 THEN 'large' WHEN amount >= 100 THEN 'medium' WHEN amount >= 10 THEN 'small'
    ELSE 'micro' END AS "amountCategory",
  CASE WHEN "merchantCategory" IN ('grocery', 'restaurant') THEN 'food_beverage'
    WHEN "merchantCategory" = 'gas_station' THEN 'automotive'
    WHEN "merchantCategory" IN ('retail', 'online', 'electronics') THEN 'retail'
    WHEN "merchantCategory" IN ('hotel', 'airline') THEN 'travel'
    WHEN "merchantCategory" = 'pharmacy' THEN 'healthcare' ELSE 'other' END AS "merchantType"
FROM transactions
""")
def e12_enrich_tx(spark, folder):
    return E.enrich_tx(transactions(spark, folder))


@query("e12_enrich_sensor", f"""
SELECT *, {_PARTS},
  CASE WHEN "sensorType" IN ('temperature', 'humidity', 'pressure') THEN 'environmental'
    WHEN "sensorType" IN ('motion', 'sound') THEN 'security'
    WHEN "sensorType" IN ('vibration', 'power', 'flow_rate') THEN 'industrial'
    WHEN "sensorType" IN ('air_quality', 'light') THEN 'comfort' ELSE 'other' END AS "sensorCategory",
  CASE WHEN "sensorType" = 'temperature' THEN CASE WHEN value < 10 THEN 'very_low' WHEN value < 18 THEN 'low'
      WHEN value <= 26 THEN 'normal' WHEN value <= 35 THEN 'high' ELSE 'very_high' END
    WHEN "sensorType" = 'humidity' THEN CASE WHEN value < 20 THEN 'very_low' WHEN value < 30 THEN 'low'
      WHEN value <= 70 THEN 'normal' WHEN value <= 85 THEN 'high' ELSE 'very_high' END
    ELSE 'unknown' END AS "valueRange",
  CASE WHEN contains(location, 'warehouse') THEN 'storage' WHEN contains(location, 'office') THEN 'office'
    WHEN contains(location, 'production') THEN 'manufacturing' WHEN contains(location, 'server') THEN 'it_infrastructure'
    ELSE 'other' END AS "locationCategory",
  CASE WHEN "batteryLevel" >= 80 THEN 'excellent' WHEN "batteryLevel" >= 50 THEN 'good'
    WHEN "batteryLevel" >= 20 THEN 'low' ELSE 'critical' END AS "batteryStatus"
FROM sensors
""")
def e12_enrich_sensor(spark, folder):
    return E.enrich_sensor(sensors(spark, folder))


@query("e13_off_hours", """
SELECT (hour(ts) >= 22 OR hour(ts) <= 6) AS "offHours", count(*) AS n, round(sum(amount), 6) AS amount
FROM transactions GROUP BY ALL
""")
def e13_off_hours(spark, folder):
    return (transactions(spark, folder).groupBy(is_off_hours(F.col("ts")).alias("offHours"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")))


@query("e14_e15_threshold_violations", """
WITH limits AS (SELECT * FROM (VALUES
  ('temperature', -40.0, 85.0), ('humidity', 0.0, 100.0), ('pressure', 0.0, 10.0), ('vibration', NULL, 50.0),
  ('light', 0.0, 100000.0), ('air_quality', NULL, 500.0), ('sound', NULL, 130.0), ('power', 0.0, 1000.0),
  ('flow_rate', 0.0, 1000.0)) AS v(t, lo, hi))
SELECT s.*, CAST(lo AS DOUBLE) AS "lowLimit", CAST(hi AS DOUBLE) AS "highLimit",
  round(CASE WHEN t = 'temperature' AND value > hi THEN least(0.9, (value - hi) / 20)
    WHEN t = 'temperature' THEN least(0.9, (lo - value) / 20)
    WHEN t = 'humidity' AND value > hi THEN least(0.9, (value - hi) / 50)
    WHEN t = 'humidity' THEN least(0.9, (lo - value) / 50) ELSE CAST(0.6 AS DOUBLE) END, 6) AS severity
FROM sensors s JOIN limits ON "sensorType" = t WHERE value < lo OR value > hi
""")
def e14_e15_threshold_violations(spark, folder):
    return E.threshold_violations(sensors(spark, folder))


@query("e17_as_number", """
SELECT "readingId", CAST(CASE WHEN "isAnomaly" THEN 1 ELSE 0 END AS DOUBLE) AS "fromBoolean",
  value AS "fromText", CAST(NULL AS DOUBLE) AS "fromWords"
FROM sensors
""")
def e17_as_number(spark, folder):
    rows = sensors(spark, folder)
    return rows.select("readingId", scoring.as_number(F.col("isAnomaly")).alias("fromBoolean"),
                       scoring.as_number(F.col("value").cast("string")).alias("fromText"),
                       scoring.as_number(F.col("location")).alias("fromWords"))


@query("e18_gauge", """
WITH g AS (SELECT "readingId", greatest(0.0, least(100.0, (value - 10) / 90.0 * 100.0)) :: DOUBLE AS g FROM sensors)
SELECT "readingId", round(g, 6) AS gauge,
  CASE WHEN g <= 33 THEN 'Good' WHEN g <= 66 THEN 'Warning' ELSE 'Critical' END AS status FROM g
""")
def e18_gauge(spark, folder):
    level = scoring.gauge(F.col("value"), 10.0, 100.0)
    return sensors(spark, folder).select("readingId", level.alias("gauge"),
                                         scoring.gauge_status(level, 33, 66).alias("status"))


@query("e19_risk_score", """
WITH seen AS (
  SELECT t.*, ts - lag(ts) OVER w AS elapsed, avg(amount) OVER past AS mean, first_value(country) OVER past AS home,
    coalesce(sum(CASE WHEN "isFraud" THEN 1 ELSE 0 END) OVER past, 0) AS frauds
  FROM transactions t WINDOW w AS (PARTITION BY "userId" ORDER BY ts, "transactionId"),
    past AS (PARTITION BY "userId" ORDER BY ts, "transactionId" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bought AS (
  SELECT t."transactionId" AS id, e."merchantCategory" AS c, rank() OVER (PARTITION BY id ORDER BY count(*) DESC) AS r
  FROM transactions t JOIN transactions e ON e."userId" = t."userId"
    AND (e.ts < t.ts OR e.ts = t.ts AND e."transactionId" < t."transactionId")
  GROUP BY id, c),
scored AS (
  SELECT s.*, round(least(1.0 :: DOUBLE,
    CASE WHEN amount > mean * 3 THEN 0.3 :: DOUBLE ELSE 0 END + CASE WHEN hour(s.ts) < 6 THEN 0.2 :: DOUBLE ELSE 0 END
    + CASE WHEN country IN ('RU', 'CN', 'NG', 'PK') THEN 0.4 :: DOUBLE WHEN country <> home THEN 0.1 :: DOUBLE ELSE 0 END
    + CASE WHEN elapsed IS NOT NULL AND coalesce(b.r, 4) > 3 THEN 0.1 :: DOUBLE ELSE 0 END
    + CASE WHEN elapsed < INTERVAL 60 second THEN 0.3 :: DOUBLE WHEN elapsed < INTERVAL 300 second THEN 0.1 :: DOUBLE
        ELSE 0 END
    + least(frauds * 0.1 :: DOUBLE, 0.3 :: DOUBLE)), 3) AS score
  FROM seen s LEFT JOIN bought b ON b.id = s."transactionId" AND b.c = s."merchantCategory")
SELECT "transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud", CAST(frauds AS BIGINT) AS "priorFrauds", score,
  CASE WHEN "isFraud" AND score > 0.7 THEN 'declined_or_review' WHEN score > 0.8 THEN 'pending_review'
    ELSE 'approved' END AS decision
FROM scored
""")
def e19_risk_score(spark, folder):
    return E.risk_score(transactions(spark, folder))


@query("e20_quality_score", """
SELECT "readingId", round(greatest(0.0 :: DOUBLE, least(1.0 :: DOUBLE, 1.0 :: DOUBLE
  - CASE WHEN "batteryLevel" < 20 THEN 0.3 :: DOUBLE WHEN "batteryLevel" < 50 THEN 0.1 :: DOUBLE ELSE 0 END
  - CASE WHEN "readingId" % 200 > 90 THEN 0.2 :: DOUBLE ELSE 0 END
  - least(("readingId" % 25) * 0.02 :: DOUBLE, 0.3 :: DOUBLE)
  - CASE WHEN "isAnomaly" THEN 0.1 :: DOUBLE ELSE 0 END)), 6) AS quality
FROM sensors
""")
def e20_quality_score(spark, folder):
    score = scoring.quality_score(F.col("batteryLevel"), F.col("readingId") % 200, F.col("readingId") % 25,
                                  F.col("isAnomaly"))
    return sensors(spark, folder).select("readingId", score.alias("quality"))


@query("e22_reading_class", """
WITH ranges AS (SELECT * FROM (VALUES
  ('temperature', 'celsius', 18.0, 26.0, -10.0, 50.0), ('humidity', 'percent', 30.0, 70.0, 0.0, 100.0),
  ('pressure', 'hPa', 1000.0, 1030.0, 950.0, 1080.0), ('light', 'lux', 100.0, 1000.0, 0.0, 50000.0),
  ('motion', 'boolean', 0.0, 1.0, 0.0, 1.0), ('air_quality', 'ppm', 50.0, 150.0, 0.0, 1000.0),
  ('vibration', 'mm/s', 0.5, 3.0, 0.0, 20.0), ('sound', 'dB', 30.0, 60.0, 0.0, 120.0),
  ('power', 'watts', 100.0, 500.0, 0.0, 2000.0), ('flow_rate', 'liters/min', 10.0, 50.0, 0.0, 200.0))
  AS v(t, unit, nlo, nhi, clo, chi))
SELECT s.*, unit, CASE WHEN value BETWEEN nlo AND nhi THEN 'normal' WHEN value BETWEEN clo AND chi THEN 'out_of_range'
  ELSE 'critical' END AS "readingClass"
FROM sensors s JOIN ranges ON "sensorType" = t
""")
def e22_reading_class(spark, folder):
    return E.classify(sensors(spark, folder))
