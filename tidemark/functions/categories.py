"""Labels for event fields. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed


def label(c: Column, groups: dict[str, list[str]], default: str) -> Column:
    """The group whose list holds ``c``."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, members in groups.items():
        out = out.when(c.isin(members), name)
    return out.otherwise(default)


def band(c: Column, bands: tuple[list[tuple[float, str]], str]) -> Column:
    """The first band whose lower bound ``c`` reaches."""
    steps, lowest = bands
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        out = out.when(c >= bound, name)
    return out.otherwise(lowest)


def event_category(c: Column) -> Column:
    return label(F.lower(c), fixed.EVENT_CATEGORY, "other")


def region(c: Column) -> Column:
    return label(c, fixed.REGION, "Other")


def timezone(c: Column) -> Column:
    return label(c, fixed.TIMEZONE, "UTC")


def risk_category(c: Column) -> Column:
    return band(c, fixed.RISK_BANDS)


def amount_category(c: Column) -> Column:
    return band(c, fixed.AMOUNT_BANDS)


def merchant_type(c: Column) -> Column:
    return label(F.lower(c), fixed.MERCHANT_TYPE, "other")


def sensor_category(c: Column) -> Column:
    return label(F.lower(c), fixed.SENSOR_CATEGORY, "other")


def value_range(value: Column, sensor_type: Column) -> Column:
    """Band of a reading; types without bands are ``unknown``."""
    out = F.when(value.isNull() | sensor_type.isNull(), F.lit(None).cast("string"))
    for kind, (very_low, low, normal, high) in fixed.VALUE_BANDS.items():
        steps = (F.when(value < very_low, "very_low").when(value < low, "low")
                 .when(value <= normal, "normal").when(value <= high, "high").otherwise("very_high"))
        out = out.when(F.lower(sensor_type) == kind, steps)
    return out.otherwise("unknown")


def location_category(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for word, name in fixed.LOCATION_CATEGORY.items():
        out = out.when(c.contains(word), name)
    return out.otherwise("other")


def battery_status(c: Column) -> Column:
    return band(c, fixed.BATTERY_BANDS)


def topic_kind(c: Column) -> Column:
    return label(c, {kind: [topic] for topic, kind in fixed.TOPIC_KINDS.items()}, "unknown")
