"""The three event views over the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed


SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its declared schema; zoneless times are read as UTC instants, which windows need."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _events(events: DataFrame) -> tuple[Column, Column, Column]:
    k = F.get_json_object("props", "$.k").cast("int")
    return k, F.concat(F.lit("user_"), F.col("user_id")), _pick(fixed.COUNTRIES, k % 10)


def user_events_of(events: DataFrame, *kept: str) -> DataFrame:
    k, user, country = _events(events)
    slot = F.floor(F.unix_micros("ts") / F.lit(21_600_000_000)).cast("string")
    return events.select(
        *kept, F.col("event_id").alias("eventId"), user.alias("userId"), F.col("event_type").alias("eventType"), "ts",
        F.concat_ws("_", user, slot).alias("sessionId"),
        F.when(F.col("event_type").isin("view", "click"),
               F.concat(F.lit("/page/"), (k % 13).cast("string"))).alias("page"),
        country.alias("country"),
        F.when(F.col("event_type") == "view", F.floor(F.col("value") * 1000)).alias("duration"))


def transactions_of(events: DataFrame, *kept: str) -> DataFrame:
    k, user, country = _events(events)
    return events.select(
        *kept, F.concat(F.lit("tx_"), F.col("event_id")).alias("transactionId"), user.alias("userId"), "ts",
        F.round(F.col("value") * 10, 2).alias("amount"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        (k / F.lit(100.0)).alias("riskScore"), country.alias("country"),
        _pick(list(fixed.MERCHANT_LIMITS), k % 10).alias("merchantCategory"), (k < 5).alias("isFraud"))


def sensors_of(events: DataFrame, *kept: str) -> DataFrame:
    k, _, _ = _events(events)
    return events.select(
        *kept, F.col("event_id").alias("readingId"), F.concat(F.lit("sensor_"), F.col("user_id")).alias("sensorId"),
        _pick(list(fixed.SENSOR_RANGES), F.col("user_id") % 10).alias("sensorType"),
        _pick(fixed.LOCATIONS, F.floor(F.col("user_id") / 10) % 10).alias("location"), "ts", "value",
        k.alias("batteryLevel"), (F.col("value") > 200).alias("isAnomaly"))


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    return user_events_of(table(spark, folder, "events"))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return transactions_of(table(spark, folder, "events"))


def sensors(spark: SparkSession, folder: str) -> DataFrame:
    return sensors_of(table(spark, folder, "events"))


# The same views for the oracle.
def _case(values: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({index} AS INT) + 1]"


_EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
_VIEWS = {
    "user_events": f"""user_events AS (
  SELECT event_id AS "eventId", 'user_' || user_id AS "userId", event_type AS "eventType", ts,
    'user_' || user_id || '_' || CAST(epoch_us(ts) // 21600000000 AS VARCHAR) AS "sessionId",
    CASE WHEN event_type IN ('view', 'click') THEN '/page/' || (k % 13) END AS page,
    {_case(fixed.COUNTRIES, 'k % 10')} AS country,
    CASE WHEN event_type = 'view' THEN CAST(floor(value * 1000) AS BIGINT) END AS duration
  FROM ev)""",
    "transactions": f"""transactions AS (
  SELECT 'tx_' || event_id AS "transactionId", 'user_' || user_id AS "userId", ts,
    round(value * 10, 2) AS amount,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    k / 100.0 AS "riskScore", {_case(fixed.COUNTRIES, 'k % 10')} AS country,
    {_case(list(fixed.MERCHANT_LIMITS), 'k % 10')} AS "merchantCategory", k < 5 AS "isFraud"
  FROM ev)""",
    "sensors": f"""sensors AS (
  SELECT event_id AS "readingId", 'sensor_' || user_id AS "sensorId",
    {_case(list(fixed.SENSOR_RANGES), 'user_id % 10')} AS "sensorType",
    {_case(fixed.LOCATIONS, '(user_id // 10) % 10')} AS location, ts, value,
    k AS "batteryLevel", value > 200 AS "isAnomaly"
  FROM ev)""",
}


def oracle(body: str) -> str:
    """A query over the views as one statement over the driver's tables."""
    body = body.strip()
    used = [sql for name, sql in _VIEWS.items() if name in body]
    if not used:
        return body
    head = "WITH " + ",\n".join([_EV, *used])
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body


# Raw messages, as a broker would deliver them: made from the same rows, some of them damaged.
def user_messages(spark: SparkSession, folder: str) -> DataFrame:
    """User events as JSON text: k = 0 is cut off, k = 1 has no user, odd k has its time as epoch milliseconds."""
    return _messages(spark, folder, user_events_of, "user-events", ["eventId", "ts"],
                     lambda k, c: F.when(k != 1, F.col(c)) if c == "userId" else F.col(c))


def transaction_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions as JSON text, damaged the same way; k = 2 has no risk score, k = 3 no country. Ten users in a row share a place."""
    lost = {"userId": 1, "riskScore": 2, "country": 3}
    place = _pick(fixed.LOCATIONS, F.floor(F.substring("userId", 6, 20).cast("bigint") / 10) % 10)
    return _messages(spark, folder, lambda e, *kept: transactions_of(e, *kept).withColumns(
                         {"currency": F.lit("USD"), "location": place}),
                     "transaction-events", ["ts"],
                     lambda k, c: F.when(k != lost[c], F.col(c)) if c in lost else F.col(c))


def sensor_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as JSON text, damaged the same way; k = 2 has no battery level, k below 50 says ``deviceType``."""
    def damage(k: Column, c: str) -> Column:
        if c == "deviceType":
            return F.when(k < 50, F.col("sensorType"))
        if c == "sensorType":
            return F.when(k >= 50, F.col("sensorType"))
        lost = {"sensorId": 1, "batteryLevel": 2}
        return F.when(k != lost[c], F.col(c)) if c in lost else F.col(c)

    return _messages(spark, folder,
                     lambda e, *kept: sensors_of(e, *kept).withColumns({"unit": F.lit("unit"), "deviceType": F.col("sensorType")}),
                     "iot-sensor-events", ["readingId", "ts"], damage)


def _messages(spark: SparkSession, folder: str, view, topic: str, left_out: list[str], damage) -> DataFrame:
    events = table(spark, folder, "events")
    named = view(events)
    k = F.col("_k")
    made = events.select("*", F.get_json_object("props", "$.k").cast("int").alias("_k"))
    made = view(made, "_k", "event_id")
    time = F.when(k % 2 == 1, F.unix_millis("ts").cast("string")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    fields = [damage(k, c).alias(c) for c in named.columns if c not in left_out]
    text = F.to_json(F.struct(time.alias("timestamp"), *fields))
    value = F.when(k == 0, F.substring(text, 1, 25)).otherwise(text)
    # The text is made once: a filter is not moved below a generator, where each use of the text would make it anew.
    return made.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
                       F.inline(F.array(F.struct(value.alias("value")))))
