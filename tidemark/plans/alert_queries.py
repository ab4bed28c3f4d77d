"""Alerts, unions and splits over whole tables."""

import re

from pyspark.sql import functions as F

from tidemark.functions.fixed_values import ALERT_SOURCES, ALERT_STATUS, ALERT_TEXTS, SENSOR_RANGES
from tidemark.operators import alerts as A
from tidemark.operators import patterns as P
from tidemark.operators import routing as R
from tidemark.plans import enrich_queries, keyed_queries, pattern_queries, window_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, query
from tidemark.sources.adapters import sensors, transactions


def _say(kind: str, *values: str, unlimited: str | None = None) -> str:
    """An alert's description; numbers are rounded half up. The first one is without limit where ``unlimited`` holds."""
    parts, rest = [], ALERT_TEXTS[kind][1]
    for value in values:
        hit = re.search(r"%(?:\.(\d))?([dfs])", rest)
        text = f"CAST(CAST({value} AS DECIMAL(28, 6)) AS DECIMAL(28, {hit[1]}))" if hit[2] == "f" else value
        text = f"CAST({text} AS VARCHAR)"
        if unlimited and not parts:
            text = f"CASE WHEN {unlimited} THEN 'Infinity' ELSE {text} END"
        parts += [f"'{rest[:hit.start()]}'", text]
        rest = rest[hit.end():]
    return " || ".join([*parts, f"'{rest}'"])


def _alert(kind: str, source: str, key: str, at: str, text: str, severity: str, details: str) -> str:
    return f"""SELECT sha256('{kind}|' || {key} || '|' || CAST(epoch_us({at}) // 1000 AS VARCHAR)) AS "alertId",
  {at} AS ts, '{kind}' AS "alertType", {details}, '{ALERT_TEXTS[kind][0]}' AS title, {text} AS description,
  round(CAST({severity} AS DOUBLE), 6) AS severity, '{ALERT_STATUS}' AS status, '{ALERT_SOURCES[source]}' AS source"""


def _fraud(kind, severity, source, *said, tx='"transactionId"'):
    head = _alert(kind, "fraud", tx, "ts", _say(kind, *said), severity, f'"userId", {tx} AS "transactionId"')
    return f"{head} FROM ({ORACLES[source]})"


_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"
_FRAUDS = [
    _fraud("VELOCITY_FRAUD", "0.9", "c1_velocity", "5", '"allTotal"', "1440"),
    _fraud("STRUCTURING_FRAUD", "0.8", "c2_structuring", "amount", "3", '"smallTotal"'),
    _fraud("GEOGRAPHIC_ANOMALY", "0.7", "c3_country_change", "country", '"nextCountry"', "360"),
    _fraud("TESTING_ATTACK", "0.85", "c4_card_testing", "3", '"successTotal"', tx='"endId"'),
    _fraud("OFF_HOURS_HIGH_RISK", '"riskScore"', "c5_off_hours", "amount", '"riskScore"', _AT),
]


@query("e16_alert_rows", _FRAUDS[4])
def e16_alert_rows(spark, folder):
    return P.off_hours(transactions(spark, folder)).select(A.off_hours_alert().alias("a")).select("a.*")


@query("u1_fraud_alerts", "\nUNION ALL\n".join(_FRAUDS))
def u1_fraud_alerts(spark, folder):
    return A.fraud_alerts(transactions(spark, folder), velocity_within="1 day", structuring_within="5 days",
                          country_within="6 hours", testing_within="72 hours")


_UNIT = "CASE \"sensorType\" " + " ".join(f"WHEN '{t}' THEN '{r[0]}'" for t, r in SENSOR_RANGES.items()) + " END"


def _anomaly(kind, severity, source, *said, real=True, unlimited=None):
    details = (f'''"sensorId", "sensorType" AS "deviceType", location, value, {_UNIT} AS unit, ts AS "readingTimestamp"''' if real else
               """"sensorId", 'UNKNOWN' AS "deviceType", 'UNKNOWN' AS location, CAST(0 AS DOUBLE) AS value,
               CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS TIMESTAMP) AS "readingTimestamp" """)
    about = """"sensorId" || '|' || CAST("readingId" AS VARCHAR)""" if real else '"sensorId"'
    head = _alert(kind, "anomaly", about, "ts", _say(kind, *said, unlimited=unlimited), severity, details)
    return f"{head} FROM ({ORACLES[source]})"


@query("u2_anomaly_alerts", "\nUNION ALL\n".join([
    _anomaly("STATISTICAL_ANOMALY", "severity", "t2_zscore", "value", '"zScore"', "mean"),
    _anomaly("THRESHOLD_VIOLATION", "severity", "e14_e15_threshold_violations", '"sensorType"', "value", _UNIT),
    _anomaly("RAPID_CHANGE", "severity", "t3_rapid_change", 'abs(value - "previousValue") / abs("previousValue") * 100',
             '"previousValue"', "value", "seconds", unlimited='"previousValue" = 0'),
    _anomaly("MISSING_DATA", "severity", "t4_data_gaps", "minutes"),
    _anomaly("SENSOR_OFFLINE", "severity", "t5_offline", "480.0", real=False),
    _anomaly("CORRELATION_ANOMALY", "severity", "a6_cross_sensor_deviation", "value", "deviation", "mean"),
]))
def u2_anomaly_alerts(spark, folder):
    units = F.create_map(*[F.lit(x) for t, r in SENSOR_RANGES.items() for x in (t, r[0])])
    readings = sensors(spark, folder).withColumn("unit", units[F.col("sensorType")])
    found = A.anomaly_alerts(readings, max_dt="2 hours", timeout="8 hours", deviation_window="1 day")
    # A severity half-way between two sixth digits is rounded as the SQL's engine does: scaled up, then to the nearest whole.
    return found.withColumn("severity", F.round(F.col("severity") * 1e6) / 1e6)


@query("u3_sensor_aggregates", f"""
SELECT "sensorType", window_start, window_end, count, sum, average, minimum, "aggregationType",
  NULL :: INT AS "dataPoints", NULL :: DOUBLE AS trend, NULL :: VARCHAR AS "trendDirection"
FROM ({ORACLES['a4_sensor_stats']})
UNION ALL
SELECT "sensorType", window_start, window_end, NULL, NULL, NULL, NULL, "aggregationType", "dataPoints", trend,
  "trendDirection"
FROM ({ORACLES['a5_sensor_trend']})
""")
def u3_sensor_aggregates(spark, folder):
    return R.sensor_aggregates(sensors(spark, folder), "6 hours", "10 hours", "2 hours",
                               ("tumbling_6h", "sliding_10h_2h"), "30 minutes")


_TX = """"transactionId", "userId", ts, amount, status, CAST("riskScore" AS DOUBLE) AS "riskScore", country,
  "merchantCategory", "isFraud" """


@query("u4_high_amounts", f"""
SELECT {_TX}, 'HIGH_AMOUNT' AS "anomalyType" FROM transactions WHERE amount > 2000
""")
def u4_high_amounts(spark, folder):
    return R.split(transactions(spark, folder), F.col("amount") > 2000, "HIGH_AMOUNT")[1]


@query("u4_main_output", f"SELECT {_TX} FROM transactions WHERE amount <= 2000")
def u4_main_output(spark, folder):
    return R.split(transactions(spark, folder), F.col("amount") > 2000, "HIGH_AMOUNT")[0]


@query("u5_routes", """
SELECT CASE WHEN amount > 2000 THEN 'anomalies' ELSE 'main' END AS route, count(*) AS n, round(sum(amount), 6) AS amount
FROM transactions GROUP BY route
""")
def u5_routes(spark, folder):
    routed = R.route(transactions(spark, folder), F.col("amount") > 2000, "anomalies")
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
