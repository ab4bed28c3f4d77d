"""Metric time series as tables: counter rates, ratios, sustained conditions, and observed counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import slicing as S
from tidemark.operators.keyed import segments


def _increase(value: str, previous: Column) -> Column:
    """Growth of a counter; a smaller value means it restarted from zero."""
    return F.when(F.col(value) < previous, F.col(value)).otherwise(F.col(value) - previous)


def counter_rate(df: DataFrame, labels: list[str], ts: str, value: str, window: str = "5 minutes",
                 tiebreak: str | None = None) -> DataFrame:
    """Increase per second over the trailing window at each sample; null with fewer than two samples in it.

    Samples of one instant are ordered by ``tiebreak``, else by value. The increase is the difference of two running
    sums, at the sample and at the first sample of its window. When a sample leaves the window, the one after it is the
    first: that one is carried along, so a sample costs the same however many share its window.
    """
    span, tie = micros(window), tiebreak or value
    sliced = S.slice_rows(df.withColumn("_p", F.unix_micros(ts)), labels, F.col("_p"), before=span)
    order = S.over_slices(labels, "_p", tie)
    grown = sliced.withColumn("_inc", F.coalesce(_increase(value, F.lag(value).over(order)), F.lit(0.0)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = grown.withColumn("_c", F.struct(F.col("_p").alias("p"), F.sum("_inc").over(upto).alias("sum")))
    known = summed.withColumns({"_next": F.lead("_c").over(order), "_start": F.first("_c").over(order)})
    before = S.over_slices(labels, "_at", "_leaves", tie).rowsBetween(Window.unboundedPreceding, -1)
    left = F.last(F.when(F.col("_leaves"), F.col("_next")), ignorenulls=True).over(before)
    seen = S.with_leavings(known, span).withColumn("_first", F.coalesce(left, "_start"))
    rate = F.try_divide(F.col("_c.sum") - F.col("_first.sum"), (F.col("_p") - F.col("_first.p")) / 1e6)
    return S.own(seen.where(~F.col("_leaves"))).select(*df.columns, rate.alias("rate"))


def instant_rate(df: DataFrame, labels: list[str], ts: str, value: str, tiebreak: str | None = None) -> DataFrame:
    """Increase per second between each sample and the one before it; samples of one instant are ordered by ``tiebreak``,
    else by value."""
    order = [ts, tiebreak or value]
    placed = S.add_earlier(S.place(df, labels, F.unix_micros(ts)), order)
    previous = F.lag(F.struct(F.col(ts).alias("ts"), F.col(value).alias("v"))).over(S.over_slices(labels, *order))
    seen = S.own(placed.rows.withColumn("_prev", previous))
    elapsed = (F.unix_micros(ts) - F.unix_micros("_prev.ts")) / 1e6
    rate = F.try_divide(_increase(value, F.col("_prev.v")), elapsed)
    return seen.select(*df.columns, rate.alias("irate"))


def utilisation(df: DataFrame, instance: str, labels: list[str], ts: str, idle: str, bucket: str = "1 minute") -> DataFrame:
    """100 minus the mean idle rate in percent, per instance and time bucket."""
    rates = instant_rate(df, labels, ts, idle).where(F.col("irate").isNotNull())
    return (rates.groupBy(instance, F.window(ts, bucket)).agg((100 - F.avg("irate") * 100).alias("utilisation"))
            .select(instance, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "utilisation"))


def ratio(num: Column, den: Column) -> Column:
    """Used share in percent, null where the whole is 0."""
    return (1 - F.try_divide(num, den)) * 100


def sustained(df: DataFrame, labels: list[str], ts: str, cond: Column, for_: str, tiebreak: str | None = None) -> DataFrame:
    """Periods in which the condition held at every sample for at least ``for_``."""
    marked = df.withColumn("_true", F.coalesce(cond, F.lit(False)))
    runs = segments(marked, labels, "_true", ts, tiebreak or ts)
    return runs.where(F.col("label") & (F.unix_micros("end") - F.unix_micros("start") >= micros(for_))).select(
        *labels, "start", "end", F.col("rows").alias("samples"))


def observe(df: DataFrame, kind: str, latency: str | None = None) -> tuple[DataFrame, Observation]:
    """Counts a table's rows (and latency) while it is used for something else; read ``Observation.get`` after."""
    seen = Observation(kind)
    exprs = [F.count(F.lit(1)).alias("processed")]
    if latency:
        exprs += [F.avg(latency).alias("meanLatency"), F.max(latency).alias("maxLatency")]
    return df.observe(seen, *exprs), seen


def latency_histogram(df: DataFrame, kind: str, latency: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Events and exact latency quantiles per kind, from the counts per latency (whole units, so few values)."""
    counted = df.groupBy(kind, F.floor(latency).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(kind).orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(kind))})
    return ranked.groupBy(kind).agg(
        F.sum("_n").alias("processed"),
        *[F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_l"))).alias(f"p{round(q * 100)}") for q in quantiles])


def latency_sketches(df: DataFrame, kind: str, latency: str, ts: str, bucket: str, k: int = 800) -> DataFrame:
    """Events and a quantile sketch of their latency per kind and window, from a table or a stream with a watermark.

    A sketch holds some multiple of ``k`` values whatever it has seen, map tasks send one per group, and sketches of several
    windows or kinds merge. The rank of a quantile is off by ``rank_error(k)`` of all events at most, save for one in a
    hundred. Rows without a latency count nowhere."""
    return (df.groupBy(kind, F.window(ts, bucket))
            .agg(F.count(latency).alias("processed"), F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"))
            .select(kind, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "processed", "sketch"))


def rank_error(k: int) -> float:
    """The published bound for one quantile of a sketch of this size, at 99 %."""
    return 2.296 / k ** 0.9021


def merged_latency(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 800) -> DataFrame:
    """Events and latency quantiles of sketches merged over all that have equal ``by``.
    What had no latency at all gives no row."""
    merged = sketches.where("processed > 0").groupBy(*by).agg(
        F.sum("processed").alias("processed"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_sketch"))
    return merged.select(*by, "processed", *[
        F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias(f"p{round(q * 100)}") for q in quantiles])
