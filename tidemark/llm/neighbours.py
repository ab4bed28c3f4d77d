"""Each row beside its successor in a global order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions


def _bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """Values of the key that cut the rows into about n equal ranges; the last is the largest value."""
    cuts = [i / n for i in range(1, n)] or [0.5]
    row = df.agg(F.percentile_approx(key, F.array(*[F.lit(c) for c in cuts]), 20 * n).alias("cuts"),
                 F.max(key).alias("top")).first()
    return [] if row.top is None else sorted({*row.cuts, row.top})


def with_next(df: DataFrame, key: str, columns: dict[str, str], tie: Column) -> DataFrame:
    """Adds to each row the columns of the row after it in descending order of ``key``; the last row gets the first one's.

    ``columns`` maps source columns to new names. The key's range is cut at values that occur, one range per shuffle
    partition; the row at a range's upper end is also copied to the range above, whose last row needs it. So the rows are
    shuffled once and no task sees more than its range. Rows without a key come last; ``tie`` orders rows of one key, and
    rows of one key stay together.
    """
    bounds = _bounds(df, key, partitions(df.sparkSession))
    values = F.array(*[F.lit(b) for b in bounds or [0]])
    own = F.coalesce(F.size(F.filter(values, lambda b: b < F.col(key))), F.lit(0))
    # the top row of range i follows the last row of range i + 1; the very first row follows the last row of all
    copy = F.when(F.col(key).isin(bounds[:-1]), own + 1).when(F.col(key) == bounds[-1], F.lit(0)) if bounds else F.lit(0)
    placed = df.withColumn("_place", F.explode(F.filter(F.array(
        F.struct(own.alias("range"), F.lit(0).alias("copied")), F.struct(copy.alias("range"), F.lit(1).alias("copied"))),
        lambda p: p["range"].isNotNull())))
    w = Window.partitionBy("_place.range").orderBy("_place.copied", F.col(key).desc_nulls_last(), tie)
    return (placed.withColumns({new: F.lead(old).over(w) for old, new in columns.items()})
            .where("_place.copied = 0").drop("_place"))
