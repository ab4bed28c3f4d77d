"""Filters, aggregations and paging over document tables."""

from __future__ import annotations

from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import slicing as S


#: Buckets made by one row of a histogram.
PART = 10_000


def count(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.count(F.lit(1)).alias("count"))


def term(name: str, value: object) -> Column:
    return F.col(name) == F.lit(value)


def range_(name: str, gte: object = None, lte: object = None) -> Column:
    """Both ends included; a side left out is open."""
    out = F.lit(True)
    if gte is not None:
        out = out & (F.col(name) >= gte)
    if lte is not None:
        out = out & (F.col(name) <= lte)
    return out


def has_tag(name: str, value: str) -> Column:
    return F.array_contains(name, value)


def all_of(df: DataFrame, *clauses: Column) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, clauses, F.lit(True)))


def terms_agg(df: DataFrame, name: str, size: int = 10) -> DataFrame:
    """The most frequent values, larger counts first, equal counts by value."""
    return (df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("doc_count"))
            .orderBy(F.desc("doc_count"), F.asc(name)).limit(size))


def date_histogram(df: DataFrame, ts: str, interval: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates per interval, with the empty intervals between the first and the last."""
    width = micros(interval)
    bucket = F.floor(F.unix_micros(ts) / width) * width
    filled = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("doc_count"),
                                                *[c.alias(n) for n, c in aggs.items()])
    filled = filled.where("_b IS NOT NULL")
    bounds = filled.groupBy().agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).where("lo IS NOT NULL")
    # Two levels, so that no row holds more than a part of the buckets.
    parts = bounds.select("hi", F.explode(F.sequence("lo", "hi", F.lit(width * PART))).alias("_from")).repartition("_from")
    last = F.least(F.col("_from") + F.lit(width * (PART - 1)), F.col("hi"))
    every = parts.select(F.explode(F.sequence("_from", last, F.lit(width))).alias("_b"))
    return (every.join(filled, "_b", "left")
            .select(F.timestamp_micros("_b").alias("bucket"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"), *aggs))


def page(df: DataFrame, key: str, after: object = None, n: int = 100) -> DataFrame:
    """The next ``n`` rows by key after the last key seen; each page is a filter and a top-n, however deep."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)


def across(tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    """The tables whose name fits the pattern, as one with the column ``index``; absent columns are null."""
    parts = [df.withColumn("index", F.lit(name)) for name, df in tables.items() if fnmatch(name, pattern)]
    if not parts:
        raise ValueError(f"no table fits {pattern!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def order_violations(df: DataFrame, key: str, arrival: str, seq: str) -> DataFrame:
    """Rows that arrived after a row of their key with a larger sequence number right before them."""
    placed = S.add_earlier(S.place(df, [key], F.col(arrival)), [arrival])
    before = F.lag(seq).over(S.over_slices([key], arrival))
    seen = S.own(placed.rows.withColumn("previousSeq", before))
    return seen.where(F.col("previousSeq") > F.col(seq))
