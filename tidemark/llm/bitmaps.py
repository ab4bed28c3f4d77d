"""A membership filter of fixed size: it lets every member through, and others seldom while it is not full."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the filter, whatever the number of members: 16 MB.
BITS = 1 << 27
_BLOCK = 32768


def slot(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64) & np.int64(BITS - 1)


def of_column(df: DataFrame, column: str) -> np.ndarray:
    """The filter's bytes over a column of hashed longs. Blocks are built in the executors; the driver gets all 16 MB at most."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1))
    blocks = (df.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect())
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for b in blocks:
        at = (b.block - 1) * (_BLOCK // 8)
        out[at:at + _BLOCK // 8] = np.frombuffer(bytes(b.bits), dtype=np.uint8)
    return out


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = slot(values)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filter_of(df: DataFrame, column: str, other: Column) -> Column:
    """A condition on ``other``: it may be in ``df``'s column. Both sides are hashed first."""
    bits = of_column(df.select(F.xxhash64(column).alias("h")), "h")
    lent = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def may(values: pd.Series) -> pd.Series:
        return pd.Series(holds(lent.value, values.to_numpy()))

    return may(F.xxhash64(other))
