"""Where queries are declared: a name, a function of (spark, folder), and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.adapters import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Times without zone and numbers to six decimals, as the oracle gives them."""
    out = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            out[field.name] = F.col(f"`{field.name}`").cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            out[field.name] = F.round(f"`{field.name}`", 6)
    return df.withColumns(out) if out else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def declare(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return finish(fn(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run

    return declare
