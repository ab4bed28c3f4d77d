"""The three event schemas as they arrive, and the registry of declared document tables, as DDL text."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import types as T


# Fields are read as text first where the wire carries more than one form (times, booleans for numbers).
USER_EVENT = (
    "userId STRING, user_id STRING, sessionId STRING, eventType STRING, timestamp STRING, page STRING, "
    "country STRING")

TRANSACTION = (
    "transactionId STRING, userId STRING, amount DOUBLE, currency STRING, status STRING, timestamp STRING, "
    "riskScore DOUBLE, country STRING, location STRING, merchantId STRING, merchantName STRING, merchantCategory STRING, "
    "paymentMethod STRING, cardNumber STRING, ipAddress STRING, userAgent STRING, deviceId STRING, "
    "authorizationCode STRING, isOnline BOOLEAN, isFraud BOOLEAN, processingTime INT, "
    "metadata STRUCT<processor: STRING, terminal_id: STRING, batch_number: STRING, response_code: STRING>")

SENSOR = (
    "sensorId STRING, sensorType STRING, deviceType STRING, value STRING, unit STRING, location STRING, "
    "timestamp STRING, batteryLevel INT, signalStrength INT, dataQuality DOUBLE, isAnomaly BOOLEAN, "
    "coordinates STRUCT<lat: DOUBLE, lon: DOUBLE>, "
    "deviceInfo STRUCT<manufacturer: STRING, model: STRING, firmwareVersion: STRING, installDate: STRING, "
    "calibrationDate: STRING, maintenanceDue: STRING>, "
    "networkInfo STRUCT<protocol: STRING, gatewayId: STRING, rssi: INT, packetLoss: DOUBLE>, "
    "metadata STRUCT<readingId: STRING, sequenceNumber: INT, errorCount: INT, samplingRate: INT, "
    "processingTime: INT, heatIndex: DOUBLE, frequency: DOUBLE, pollutant: STRING>")

# Declared document tables by name pattern; the first pattern that fits applies.
DOCUMENT_TABLES: dict[str, str] = {
    "user-events*": (
        "doc_id STRING, ts TIMESTAMP, userId STRING, sessionId STRING, eventType STRING, page STRING, "
        "country STRING, duration BIGINT"),
    "transaction-events*": (
        "doc_id STRING, ts TIMESTAMP, transactionId STRING, userId STRING, amount DOUBLE, currency STRING, "
        "status STRING, country STRING, merchantCategory STRING, riskScore DOUBLE, isFraud BOOLEAN"),
    "iot-sensor-events*": (
        "doc_id STRING, ts TIMESTAMP, sensorId STRING, sensorType STRING, value DOUBLE, unit STRING, "
        "location STRING, batteryLevel INT, isAnomaly BOOLEAN"),
}


def declared(name: str, registry: dict[str, str] | None = None) -> T.StructType | None:
    """The schema declared for a table name."""
    for pattern, schema in (registry or DOCUMENT_TABLES).items():
        if fnmatch(name, pattern):
            return T.StructType.fromDDL(schema)
    return None
