"""Small tables that several tests build."""

from datetime import datetime, timedelta, timezone

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


TX = ("transactionId STRING, userId STRING, ts TIMESTAMP, amount DOUBLE, status STRING, riskScore DOUBLE, "
      "country STRING, merchantCategory STRING, isFraud BOOLEAN")
READING = ("readingId BIGINT, sensorId STRING, sensorType STRING, location STRING, ts TIMESTAMP, value DOUBLE, "
           "batteryLevel INT, isAnomaly BOOLEAN")
EVENT = "eventId BIGINT, userId STRING, eventType STRING, ts TIMESTAMP, sessionId STRING, page STRING, country STRING"


def transactions(spark, rows):
    """Rows as (seconds, amount, status[, country[, user]])."""
    full = []
    for i, row in enumerate(rows):
        seconds, amount, status, country, user = (*row, *("US", "u")[len(row) - 3:]) if len(row) < 5 else row
        full.append((f"t{i:03d}", user, at(seconds), float(amount), status, 0.1, country, "retail", False))
    return spark.createDataFrame(full, TX)


def readings(spark, rows, kind="temperature", location="hall"):
    """Rows as (seconds, value[, sensor])."""
    full = [(i, row[2] if len(row) > 2 else "s", kind, location, at(row[0]), float(row[1]), 50, False)
            for i, row in enumerate(rows)]
    return spark.createDataFrame(full, READING)


def events(spark, rows):
    """Rows as (seconds, type, session[, user])."""
    full = [(i, row[3] if len(row) > 3 else "u", row[1], at(row[0]), row[2], None, "US") for i, row in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)
