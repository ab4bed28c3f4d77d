"""Unions, splits and fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import windows as W


def route(df: DataFrame, cond: Column, label: str, main: str = "main") -> DataFrame:
    """All rows with the column ``route``; partition a sink by it to write both outputs from one scan."""
    return df.withColumn("route", F.when(cond, label).otherwise(main))


def split(df: DataFrame, cond: Column, label: str, kind: str = "anomalyType") -> tuple[DataFrame, DataFrame]:
    """(rows that do not meet the condition, rows that do with their label)."""
    meets = F.coalesce(cond, F.lit(False))
    return df.where(~meets), df.where(meets).withColumn(kind, F.lit(label))


def split_stream(cond: Column, label: str, main: Callable[[DataFrame, int], None],
                 side: Callable[[DataFrame, int], None], ledger: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands both outputs of each batch to their writers.

    With a ``ledger``, a folder that outlives the driver, an output is noted there once its writer has returned, and a batch
    that is run again after a failure hands out only what is not noted. A writer that fails half way is called again, and so
    is one whose driver is lost before the note: it must replace what it wrote of the batch."""
    def write(batch: DataFrame, number: int) -> None:
        due = [out for out in ("main", "side") if ledger is None or not _noted(batch.sparkSession, ledger, out, number)]
        if not due:
            return
        kept = batch.persist()
        try:
            rest, hits = split(kept, cond, label)
            for out in due:
                (main if out == "main" else side)(rest if out == "main" else hits, number)
                if ledger is not None:
                    note = batch.sparkSession.createDataFrame([(number,)], "batch long")
                    note.write.mode("overwrite").parquet(f"{ledger}/{out}/batch-{number}")
        finally:
            kept.unpersist()

    return write


def _noted(spark: SparkSession, ledger: str, out: str, number: int) -> bool:
    try:
        return not spark.read.schema("batch long").parquet(f"{ledger}/{out}/batch-{number}").isEmpty()
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def sensor_aggregates(sensors: DataFrame, size: str = "5 minutes", span: str = "10 minutes", slide: str = "2 minutes",
                      labels: tuple[str, str] = ("tumbling_5min", "sliding_10min_2min"),
                      slice_width: str = "10 seconds") -> DataFrame:
    """Statistics and trends of the sensors as one table; columns of the other kind are null."""
    trend = W.sensor_trend_stream if sensors.isStreaming else W.sensor_trend
    return W.sensor_stats(sensors, size, labels[0]).unionByName(
        trend(sensors, span, slide, labels[1], slice_width), allowMissingColumns=True)
