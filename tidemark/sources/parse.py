"""JSON text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.scoring import as_number
from tidemark.functions.times import event_time

_NAMED = ["userId", "sessionId", "eventType", "timestamp", "page", "country"]


def parse_user_events(df: DataFrame, value: str = "value") -> DataFrame:
    """User events; a record without its required fields becomes ``unknown`` / ``parse_error`` with no time.

    Fields that have no column of their own go to the map ``additionalData``.
    """
    rest = F.map_filter(F.from_json(value, "map<string,string>"), lambda k, _: ~k.isin(_NAMED))
    parsed = df.withColumns({"_e": F.from_json(value, schemas.USER_EVENT), "_rest": rest})
    parsed = parsed.withColumn("_ts", event_time(F.col("_e.timestamp")))
    good = (F.col("_e.userId").isNotNull() & F.col("_e.sessionId").isNotNull()
            & F.col("_e.eventType").isNotNull() & F.col("_ts").isNotNull())

    def if_good(c: Column, otherwise: str | None = None) -> Column:
        return F.when(good, c).otherwise(F.lit(otherwise)) if otherwise else F.when(good, c)

    carried = [c for c in df.columns if c != value]
    return parsed.select(
        *carried, if_good(F.col("_e.userId"), "unknown").alias("userId"),
        if_good(F.col("_e.sessionId")).alias("sessionId"),
        if_good(F.col("_e.eventType"), "parse_error").alias("eventType"), if_good(F.col("_ts")).alias("ts"),
        if_good(F.col("_e.page")).alias("page"), if_good(F.col("_e.country")).alias("country"),
        if_good(F.col("_rest")).alias("additionalData"))


def _read(df: DataFrame, value: str, schema: str) -> DataFrame:
    """The fields of a JSON column. ``inline`` keeps later filters from parsing the text once more per field."""
    carried = [c for c in df.columns if c != value]
    return df.select(*carried, F.inline(F.array(F.from_json(value, schema))))


def parse_transactions(df: DataFrame, value: str = "value") -> DataFrame:
    """Transactions; records without a required field are dropped."""
    rows = _read(df, value, schemas.TRANSACTION).withColumn("ts", event_time(F.col("timestamp"))).drop("timestamp")
    rows = rows.dropna(subset=["transactionId", "userId", "amount", "currency", "status", "ts"])
    return rows.withColumns({
        "riskScore": F.coalesce("riskScore", F.lit(0.0)), "country": F.coalesce("country", F.lit("UNKNOWN")),
        "merchantId": F.coalesce("merchantId", F.lit("UNKNOWN"))})


def parse_sensors(df: DataFrame, value: str = "value") -> DataFrame:
    """Sensor readings; the type may be called ``sensorType`` or ``deviceType``; incomplete records are dropped."""
    rows = _read(df, value, schemas.SENSOR).withColumns({
        "ts": event_time(F.col("timestamp")), "value": as_number(F.col("value")),
        "sensorType": F.coalesce("deviceType", "sensorType")}).drop("timestamp", "deviceType")
    rows = rows.dropna(subset=["sensorId", "sensorType", "value", "unit", "location", "ts"])
    return rows.withColumn("batteryLevel", F.coalesce("batteryLevel", F.lit(100)))


def parse_generic(df: DataFrame, on_error: str = "envelope", value: str = "value") -> DataFrame:
    """Any JSON as the variant ``doc``; text that is none is dropped or kept as an error with the original."""
    parsed = df.select("*", F.explode(F.array(F.try_parse_json(value))).alias("doc"))
    bad = F.col("doc").isNull()
    if on_error == "drop":
        return parsed.where(~bad).drop(value)
    return parsed.withColumns({"error": F.when(bad, "Invalid JSON"), "original": F.when(bad, F.col(value))}).drop(value)


def field(name: str, kind: str = "string") -> Column:
    """A field of ``doc``, null where absent or of another kind."""
    return F.try_variant_get("doc", f"$.{name}", kind)


def location_key(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def evolve(df: DataFrame, aliases: dict[str, list[str]], defaults: dict[str, str], version: str = "2.0",
           time: str = "timestamp") -> DataFrame:
    """Older records in the current form: renamed fields, defaults, a version tag, and the time as a timestamp."""
    have = set(df.columns)
    out = {"schemaVersion": F.lit(version)}
    for name, olds in aliases.items():
        out[name] = F.coalesce(*[F.col(c) for c in [name, *olds] if c in have])
    for name, default in defaults.items():
        out[name] = F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    if time in have:
        out[time] = event_time(F.col(time))
    return df.withColumns(out).drop(*[c for olds in aliases.values() for c in olds])


def stamp(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns({"processedAt": F.current_timestamp(), "eventSource": F.lit(source)})
