"""Event time: reading it, its parts, and the integer position operators order by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}


def micros(span: str | int | float) -> int:
    """``"5 minutes"`` as microseconds; a bare number counts seconds."""
    if isinstance(span, (int, float)):
        return round(span * 1_000_000)
    total = 0
    for number, unit in re.findall(r"(\d+)\s*([a-z]+?)s?\b", span.strip().lower()):
        total += int(number) * _UNIT_MICROS[unit]
    if total <= 0:
        raise ValueError(f"no time span: {span!r}")
    return total


def seconds(span: str | int | float) -> float:
    return micros(span) / 1_000_000


def event_time(c: Column) -> Column:
    """ISO-8601 text or epoch milliseconds as a timestamp; null where it is neither."""
    text = c.cast("string")
    # The digits are tested first: a failing try_cast costs an exception per row.
    return F.when(text.rlike("^[+-]?[0-9]{1,18}$"), F.timestamp_millis(text.try_cast("bigint"))).otherwise(
        F.try_to_timestamp(text))


def time_parts(ts: Column) -> dict[str, Column]:
    """Calendar fields of an event in the session's zone; weeks start on Monday with 1."""
    return {
        "date": F.date_format(ts, "yyyy-MM-dd"),
        "hour": F.hour(ts),
        "dayOfWeek": F.weekday(ts) + 1,
        "month": F.month(ts),
        "year": F.year(ts),
    }


def is_off_hours(ts: Column, tz: str = "UTC", start: int = 22, end: int = 6) -> Column:
    """At or after ``start`` o'clock, or up to the last minute of hour ``end``."""
    hour = F.hour(ts if tz == "UTC" else F.from_utc_timestamp(ts, tz))
    return (hour >= start) | (hour <= end)


def position(ts: Column) -> Column:
    return F.unix_micros(ts)


def late_filter(df: DataFrame, cond: Column, ts: str = "ts") -> DataFrame:
    """Filters a stream above its watermark, so that the rows left out still move it.

    Spark moves a filter below the watermark unless its condition names the event time.
    """
    return df.where(F.when(F.col(ts).isNotNull(), cond) if df.isStreaming else cond)
