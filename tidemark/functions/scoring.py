"""Severity, quality and gauge formulas, and the small tables of limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed


def _values_table(spark: SparkSession, schema: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    def literal(v: object, kind: str) -> str:
        body = "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
        return f"CAST({body} AS {kind})"

    body = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(r, schema)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(n for n, _ in schema)})")


def alert_limits(spark: SparkSession) -> DataFrame:
    """One row per sensor type: nine rows, safe to broadcast."""
    return _values_table(
        spark, [("limitType", "string"), ("lowLimit", "double"), ("highLimit", "double")],
        [(t, lo, hi) for t, (lo, hi) in fixed.ALERT_LIMITS.items()])


def sensor_ranges(spark: SparkSession) -> DataFrame:
    """One row per sensor type: ten rows, safe to broadcast."""
    return _values_table(
        spark, [("sensorType", "string"), ("rangeUnit", "string"), ("normalLow", "double"),
                ("normalHigh", "double"), ("criticalLow", "double"), ("criticalHigh", "double")],
        [(t, *r) for t, r in fixed.SENSOR_RANGES.items()])


def merchant_limits(spark: SparkSession) -> DataFrame:
    """One row per merchant category: ten rows, safe to broadcast."""
    return _values_table(
        spark, [("merchantCategory", "string"), ("usualMin", "double"), ("usualMax", "double"),
                ("fraudMultiplier", "double")],
        [(c, *r) for c, r in fixed.MERCHANT_LIMITS.items()])


def threshold_severity(sensor_type: Column, value: Column, low: Column, high: Column) -> Column:
    """How far a reading lies beyond its limit, at most 0.9; 0.6 for types without a span."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for kind, span in fixed.SEVERITY_SPAN.items():
        mine = F.lower(sensor_type) == kind
        out = out.when(mine & (value > high), F.least(F.lit(0.9), (value - high) / span))
        out = out.when(mine & (value < low), F.least(F.lit(0.9), (low - value) / span))
    return out.otherwise(0.6)


def as_number(c: Column) -> Column:
    """A reading as a number: booleans become 1 and 0, text that is no number becomes null."""
    text = F.lower(c.cast("string"))
    # A first look spares most text that is no number the exception a failing try_cast costs.
    return (F.when(text == "true", 1.0).when(text == "false", 0.0)
            .when(text.rlike("^\\s*[+-]?[0-9.]"), text.try_cast("double")))


def gauge(value: Column, low: float, high: float) -> Column:
    """Position of a value between two ends, 0 to 100; null where the ends are equal."""
    if high == low:
        return F.lit(None).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) / (high - low) * 100.0))


def gauge_status(normalised: Column, good: float, warning: float) -> Column:
    return (F.when(normalised <= good, "Good").when(normalised <= warning, "Warning")
            .when(normalised.isNotNull(), "Critical"))


def quality_score(battery: Column, days_since_calibration: Column, errors: Column, is_anomaly: Column) -> Column:
    """Data quality of a reading, 0 to 1."""
    w = fixed.QUALITY_WEIGHTS
    score = (
        F.lit(1.0)
        - F.when(battery < w["battery_low"], w["low"]).when(battery < w["battery_half"], w["half"]).otherwise(0.0)
        - F.when(days_since_calibration > w["calibration_days"], w["calibration"]).otherwise(0.0)
        - F.least(F.coalesce(errors, F.lit(0)) * w["per_error"], F.lit(w["most_errors"]))
        - F.when(is_anomaly, w["anomaly"]).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def classify_reading(value: Column, normal: tuple[Column, Column], critical: tuple[Column, Column]) -> Column:
    """``normal``, ``out_of_range`` or ``critical``; null without ranges."""
    return (F.when(value.between(*normal), "normal")
            .when(value.between(*critical), "out_of_range")
            .when(value.isNotNull() & critical[0].isNotNull(), "critical"))


def review_status(is_fraud: Column, risk: Column) -> Column:
    """What happens to a transaction with this score."""
    return (F.when(is_fraud & (risk > 0.7), "declined_or_review").when(risk > 0.8, "pending_review")
            .otherwise("approved"))
