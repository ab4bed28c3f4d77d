"""As-of joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import slicing as S


def asof_join(left: DataFrame, right: DataFrame, key: str, name: str, right_id: str, ts: str = "ts",
              tolerance: str | None = None, how: str = "inner") -> DataFrame:
    """Each left row with the latest right row of its key at or before its time, as the struct column ``name``.

    Both sides go through one shuffle as one table of rows in time order (right before left at the same time,
    right rows of one time by id); no pairs are formed. A hot key is sliced, each slice starting from the last right row before it.
    """
    no_left, no_right, no_id = _empty(left), _empty(right), F.lit(None).cast(right.schema[right_id].dataType)
    lefts = left.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), no_id.alias("_id"),
                        F.struct(*left.columns).alias("_left"), no_right.alias("_right"))
    rights = right.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"),
                          F.col(right_id).alias("_id"), no_left.alias("_left"),
                          F.struct(*right.columns).alias("_right"))
    both = lefts.unionByName(rights)
    order = ["_ts", "_side", "_id"]
    placed = S.add_earlier(S.place(both, ["_key"], F.unix_micros("_ts")), order, F.col("_side") == 0)
    latest = F.last(F.when(F.col("_side") == 0, F.struct("_right", "_ts")), ignorenulls=True).over(
        S.over_slices(["_key"], *order).rowsBetween(Window.unboundedPreceding, 0))
    met = S.own(placed.rows.withColumn("_hit", latest)).where("_side = 1")
    found: Column = F.col("_hit._right")
    if tolerance is not None:
        near = F.unix_micros("_ts") - F.unix_micros("_hit._ts") <= micros(tolerance)
        found = F.when(near, found)
    out = met.select("_left.*", found.alias(name))
    if how == "inner":
        return out.where(F.col(name).isNotNull())
    return out.unionByName(left.where(F.col(ts).isNull()).withColumn(name, no_right))


def _empty(df: DataFrame) -> Column:
    return F.lit(None).cast(df.schema)


def lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object] | None = None,
           small: bool = False) -> DataFrame:
    """Every row with its dimension columns, defaults where the key is unknown.

    ``small`` is for dimensions of fixed size (limits, categories); others are broadcast only where Spark measures
    them below its threshold, and otherwise joined by shuffle, where adaptive execution splits skewed keys.
    """
    out = df.join(F.broadcast(dim) if small else dim, key, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}
    return out.withColumns(filled) if filled else out
