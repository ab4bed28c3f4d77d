"""What the dashboard asks: recent rows, distributions, filters, counters. "Now" is always an argument."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import TIME_RANGES
from tidemark.operators import windows as W


def recent(df: DataFrame, n: int = 10, ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """The newest rows: each task keeps ``n``, so nothing is sorted as a whole."""
    order = [F.desc(ts), *([F.desc(tiebreak)] if tiebreak else [])]
    return df.orderBy(*order).limit(n)


def distribution(df: DataFrame, name: str, last: int = 100, tiebreak: str | None = None,
                 label: Column | None = None) -> DataFrame:
    """Counts per value among the newest rows."""
    shown = (F.col(name) if label is None else label).alias("label")
    return recent(df, last, tiebreak=tiebreak).groupBy(shown).agg(F.count(F.lit(1)).alias("value"))


def top(df: DataFrame, name: str, last: int = 100, n: int = 10, tiebreak: str | None = None) -> DataFrame:
    """The most frequent values among the newest rows, equal counts by value."""
    return distribution(df, name, last, tiebreak).orderBy(F.desc("value"), F.asc("label")).limit(n)


def distinct_recent(df: DataFrame, name: str, last: int = 100, tiebreak: str | None = None) -> DataFrame:
    return recent(df, last, tiebreak=tiebreak).groupBy().agg(F.count_distinct(name).alias("distinctValues"))


def distinct_types(users: DataFrame, tx: DataFrame, sensors: DataFrame) -> DataFrame:
    """Distinct event types, transaction statuses and sensor types."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(name).alias("type")).distinct()
             for kind, df, name in (("user", users, "eventType"), ("transaction", tx, "status"),
                                    ("iot", sensors, "sensorType"))]
    return reduce(DataFrame.unionByName, parts)


def filter_options(users: DataFrame, tx: DataFrame) -> DataFrame:
    """The choices of the filter panel: event types, countries, and users of both tables, sorted for display."""
    parts = [users.select(F.lit("eventType").alias("option"), F.col("eventType").alias("value")),
             users.select(F.lit("country").alias("option"), F.col("country").alias("value")),
             users.select(F.lit("userId").alias("option"), F.col("userId").alias("value")),
             tx.select(F.lit("userId").alias("option"), F.col("userId").alias("value"))]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("option", "value")


@dataclass(frozen=True)
class Filter:
    """Filter settings; empty lists and missing amounts do not restrict."""

    time_range: str = "5m"
    event_types: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    user_ids: list[str] = field(default_factory=list)
    min_amount: float | None = None
    max_amount: float | None = None
    show_anomalies: bool = False
    show_fraud: bool = False


def preset(name: str, base: Filter | None = None) -> Filter:
    """One of the quick filters applied to the present settings."""
    changes = {
        "fraud": {"show_fraud": True, "time_range": "1h"},
        "anomalies": {"show_anomalies": True, "time_range": "15m"},
        "recent": {"time_range": "1m"},
        "high-value": {"min_amount": 1000.0, "time_range": "1h"},
    }
    return replace(base or Filter(), **changes[name])


def newest(df: DataFrame, ts: str = "ts") -> Column:
    """The newest time of a table, as the "now" of a repeatable query."""
    return df.groupBy().agg(F.max(ts)).scalar()


def _since(df: DataFrame, f: Filter, now: Column | None) -> Column:
    if f.time_range not in TIME_RANGES:
        raise ValueError(f"time range {f.time_range!r}; known ones are {', '.join(TIME_RANGES)}")
    span = TIME_RANGES[f.time_range]
    return F.col("ts") >= (newest(df) if now is None else now) - F.expr(f"INTERVAL {span}")


def filter_users(df: DataFrame, f: Filter, now: Column | None = None) -> DataFrame:
    cond = _since(df, f, now)
    for name, allowed in (("eventType", f.event_types), ("country", f.countries), ("userId", f.user_ids)):
        if allowed:
            cond = cond & F.col(name).isin(allowed)
    return df.where(cond)


def filter_tx(df: DataFrame, f: Filter, now: Column | None = None) -> DataFrame:
    cond = _since(df, f, now)
    if f.min_amount is not None:
        cond = cond & (F.col("amount") >= f.min_amount)
    if f.max_amount is not None:
        cond = cond & (F.col("amount") <= f.max_amount)
    if f.user_ids:
        cond = cond & F.col("userId").isin(f.user_ids)
    return df.where(cond & F.col("isFraud")) if f.show_fraud else df.where(cond)


def filter_sensors(df: DataFrame, f: Filter, now: Column | None = None) -> DataFrame:
    cond = _since(df, f, now)
    return df.where(cond & F.col("isAnomaly")) if f.show_anomalies else df.where(cond)


def flagged(df: DataFrame, flag: str, n: int = 10, tiebreak: str | None = None) -> DataFrame:
    """The newest rows that carry the flag."""
    return recent(df.where(F.col(flag)), n, tiebreak=tiebreak)


def share(df: DataFrame, label: str, value: str) -> DataFrame:
    """Share of the total in percent (one decimal), 0 where the total is 0. For aggregated rows."""
    total = df.groupBy().agg(F.sum(value)).scalar()
    percent = F.coalesce(F.try_divide(100.0 * F.col(value), total), F.lit(0.0))
    return df.select(label, value, F.round(percent, 1).alias("percent"))


def freshness(df: DataFrame, now: Column, max_age: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """The newest time, and whether it is older than ``max_age``."""
    last = df.groupBy().agg(F.max(ts).alias("lastUpdate"))
    return last.select("lastUpdate", (now - F.expr(f"INTERVAL {max_age}") > F.col("lastUpdate")).alias("stale"))


def counts_by_kind(messages: DataFrame) -> DataFrame:
    return W.running_counters(messages).select("userEvents", "transactions", "iotEvents", "total")
