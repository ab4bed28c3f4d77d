"""Keyed operators on tables: each row looks at earlier or later rows of its key in (time, id) order.

Hot keys are cut into slices (see ``slicing``); the rules below are plain windows over (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import slicing as S

SECOND = 1_000_000


def _pos(ts: str) -> Column:
    return F.unix_micros(ts)


# Runs of rows: sessions, sustained conditions -----------------------------------------------------------------

def _narrow(df: DataFrame, key: list[str], label: str, ts: str, tiebreak: str) -> S.Placed:
    narrow = df.select(*key, F.col(label).alias("_label"), F.col(ts).alias("_ts"), F.col(tiebreak).alias("_id"))
    return S.place(narrow, key, _pos("_ts"))


def segments(df: DataFrame, key: list[str], label: str, ts: str, tiebreak: str,
             gap: str | float | None = None) -> DataFrame:
    """Runs of consecutive rows with the same label and no time gap of ``gap`` or more.

    Per run: start, end, number of rows, and time and label of the row after it. Runs are formed inside slices;
    only the first and last run of a slice can continue elsewhere, and only those are joined up across slices.
    """
    return _runs(_narrow(df, key, label, ts, tiebreak), gap)


def _runs(placed: S.Placed, gap: str | float | None) -> DataFrame:
    key, order = placed.key, ["_ts", "_id"]
    w = S.over_slices(key, *order)
    row = F.struct("_ts", "_label", "_own")
    seen = S.add_neighbours(placed, order).rows.withColumns({"_prev": F.lag(row).over(w), "_next": F.lead(row).over(w)})
    starts = F.col("_prev").isNull() | ~F.col("_prev._label").eqNullSafe(F.col("_label"))
    if gap is not None:
        starts = starts | (_pos("_ts") - _pos("_prev._ts") >= micros(gap))
    numbered = seen.where("_own").withColumns({
        "_run": F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_last": F.col("_next").isNull() | ~F.col("_next._own")})
    runs = numbered.groupBy(*key, "_hot", "_slice", "_run").agg(
        F.first("_label").alias("label"), F.min("_ts").alias("start"), F.max("_ts").alias("end"),
        F.count(F.lit(1)).alias("rows"), F.max("_last").alias("_last"),
        F.max_by(F.struct(F.col("_next._ts").alias("ts"), F.col("_next._label").alias("label")),
                 F.struct("_ts", "_id")).alias("_after"))
    kept = [*key, "label", "start", "end", "rows", F.col("_after.ts").alias("next_ts"),
            F.col("_after.label").alias("next_label")]
    if placed.busy is None:
        return runs.select(*kept)
    runs = S.stored(runs)
    open_run = F.col("_hot") & ((F.col("_run") == 0) | F.col("_last"))
    whole = runs.where(~open_run).select(*kept)
    across = Window.partitionBy(*key).orderBy("_slice", "_run")
    joined = (runs.where(open_run)
              .withColumn("_no", F.sum(F.when(F.col("_run") > 0, 1).otherwise(0)).over(
                  across.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*key, "_no").agg(
                  F.min_by("label", F.struct("_slice", "_run")).alias("label"), F.min("start").alias("start"),
                  F.max("end").alias("end"), F.sum("rows").alias("rows"),
                  F.max_by("_after", F.struct("_slice", "_run")).alias("_after")).select(*kept))
    return whole.unionByName(joined)


def _horizon(placed: S.Placed, delay: str) -> Column:
    """The newest position of all rows, less the delay; null without rows. It was found while the rows were counted."""
    return F.lit(None if placed.newest is None else placed.newest - micros(delay)).cast("bigint")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 seconds", tiebreak: str = "eventId") -> DataFrame:
    """Sessions per user: a new one begins when the session id changes or after ``gap`` without events.

    ``timeout`` if the next event came ``gap`` or more later, or none came and the newest event of all, less
    ``delay``, is that far; ``ended`` if another session began sooner; else ``active``.
    """
    span = micros(gap)
    placed = _narrow(events, ["userId"], "sessionId", "ts", tiebreak)
    runs, horizon = _runs(placed, gap), _horizon(placed, delay)
    next_pos, end = _pos("next_ts"), _pos("end")
    status = (F.when(next_pos - end >= span, "timeout").when(F.col("next_ts").isNotNull(), "ended")
              .when(end + span <= horizon, "timeout").otherwise("active"))
    return runs.select(
        "userId", F.col("label").alias("sessionId"), F.col("start").alias("sessionStart"),
        F.col("end").alias("sessionEnd"),
        (F.unix_millis("end") - F.unix_millis("start")).alias("duration"),
        F.col("rows").cast("int").alias("eventCount"), status.alias("status"))


def gap_sessions(df: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", tiebreak: str = "eventId") -> DataFrame:
    """Sessions by time gap alone; rows exactly ``gap`` apart belong together, as in Spark's session windows.

    On a table these are runs, which split hot keys; a stream uses the session window."""
    if df.isStreaming:
        return (df.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("eventCount"))
                .select(key, F.col("session_window.start").alias("window_start"),
                        F.col("session_window.end").alias("window_end"), "eventCount"))
    runs = segments(df.withColumn("_same", F.lit(0)), [key], "_same", ts, tiebreak, (micros(gap) + 1) / SECOND)
    return runs.select(key, F.col("start").alias("window_start"),
                       F.timestamp_micros(_pos("end") + micros(gap)).alias("window_end"), F.col("rows").alias("eventCount"))


# Sensors ------------------------------------------------------------------------------------------------------

def zscore_alerts(readings: DataFrame, n: int = 100, min_n: int = 10, z: float = 2.5) -> DataFrame:
    """Readings more than ``z`` population deviations from the mean of the sensor's last ``n``, itself included."""
    scored = S.last_rows(S.place(readings, ["sensorId"], _pos("ts")), ["ts", "readingId"], "value", n)
    return (scored.where((F.col("_n") >= min_n) & (F.col("_std") > 0))
            .withColumn("zScore", F.col("_off") / F.col("_std")).where(F.col("zScore") > z)
            .withColumn("severity", F.least(F.lit(0.9), F.col("zScore") / z))
            .withColumnsRenamed({"_n": "readings", "_mean": "mean"}).drop("_off", "_std", "_prev"))


def relative_change(value: Column, previous: Column) -> Column:
    """Change as a share of the previous value; any change from zero counts as unlimited."""
    change = F.abs(value - previous)
    return F.when(previous == 0, F.when(change > 0, F.lit(float("inf")))).otherwise(
        F.try_divide(change, F.abs(previous)))


def rapid_change(readings: DataFrame, max_dt: str = "300 seconds", rel: float = 0.5) -> DataFrame:
    """Readings that changed by more than ``rel`` from the sensor's previous one, less than ``max_dt`` before."""
    span, order = micros(max_dt), ["ts", "readingId"]
    placed = S.add_earlier(S.place(readings, ["sensorId"], _pos("ts")), order)
    w = S.over_slices(["sensorId"], *order)
    seen = S.own(placed.rows.withColumns({"previousTs": F.lag("ts").over(w), "previousValue": F.lag("value").over(w)}))
    elapsed = _pos("ts") - _pos("previousTs")
    change = relative_change(F.col("value"), F.col("previousValue"))
    return (seen.where((elapsed > 0) & (elapsed < span)).withColumn("relativeChange", change)
            .where(F.col("relativeChange") > rel)
            .withColumn("seconds", (_pos("ts") - _pos("previousTs")) / float(SECOND))
            .withColumn("severity", F.least(F.lit(0.9), F.col("relativeChange"))).drop("previousTs"))


def data_gaps(readings: DataFrame, timeout: str = "5 minutes") -> DataFrame:
    """Readings that came more than ``timeout`` after the sensor's previous one."""
    order = ["ts", "readingId"]
    placed = S.add_earlier(S.place(readings, ["sensorId"], _pos("ts")), order)
    previous = F.lag("ts").over(S.over_slices(["sensorId"], *order))
    seen = S.own(placed.rows.withColumn("_gap", _pos("ts") - F.unix_micros(previous)))
    return (seen.where(F.col("_gap") > micros(timeout)).withColumn("minutes", F.col("_gap") / 60_000_000.0)
            .withColumn("severity", F.lit(0.7)).drop("_gap"))


def offline(readings: DataFrame, timeout: str = "5 minutes", delay: str = "10 seconds") -> DataFrame:
    """Times at which a sensor had been silent for ``timeout``: after each gap longer than that, and at the end."""
    span, order = micros(timeout), ["ts", "readingId"]
    narrow = readings.select("sensorId", "ts", "readingId")
    placed = S.add_later(S.place(narrow, ["sensorId"], _pos("ts")), order)
    seen = S.own(placed.rows.withColumn("_next", F.unix_micros(F.lead("ts").over(S.over_slices(["sensorId"], *order)))))
    horizon = _horizon(placed, delay)
    silent = F.when(F.col("_next").isNull(), _pos("ts") + span <= horizon).otherwise(F.col("_next") - _pos("ts") > span)
    return seen.where(silent).select(
        "sensorId", "readingId", F.col("ts").alias("lastSeen"), F.timestamp_micros(_pos("ts") + span).alias("ts"),
        F.lit(0.8).alias("severity"))


# Users --------------------------------------------------------------------------------------------------------

def velocity_count(tx: DataFrame, window: str = "300 seconds", more_than: int = 5, tiebreak: str = "transactionId") -> DataFrame:
    """Transactions by which the user has more than ``more_than`` in the trailing window, both ends included.

    Transactions of one instant count in the order of their ids, as they would arrive. Every row also leaves, one
    window later and after all that arrives then, so the count is one running sum however full the window is.
    """
    span = micros(window)
    sliced = S.slice_rows(tx.withColumn("_p", _pos("ts")), ["userId"], F.col("_p"), before=span)
    moves = S.with_leavings(sliced, span)
    running = S.over_slices(["userId"], "_at", "_leaves", tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = moves.withColumn("transactionCount", F.sum(F.when(F.col("_leaves"), -1).otherwise(1)).over(running))
    return S.own(counted.where(~F.col("_leaves"))).where(F.col("transactionCount") > more_than).drop("_p", "_at", "_leaves")


def rate_limit(tx: DataFrame, per: str = "minute", n: int = 100, tiebreak: str = "transactionId") -> DataFrame:
    """The first ``n`` rows of each user and calendar unit; map tasks already drop the rest."""
    w = Window.partitionBy("userId", F.date_trunc(per, "ts")).orderBy("ts", tiebreak)
    return tx.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= n).drop("_no")


def running_stats(events: DataFrame, action: str = "action", tiebreak: str = "eventId") -> DataFrame:
    """Milliseconds since the user's previous event (0 for the first) and the running count of the same action."""
    key, order = ["userId"], ["ts", tiebreak]
    named = events.withColumn("_action", F.coalesce(F.col(action), F.lit("unknown")))
    near = S.add_earlier(S.place(named, key, _pos("ts")), order)
    counted = S.add_totals(near, {"_one": F.lit(1).cast("bigint")}, more=("_action",)).rows
    # Rows of totals have no time; they must not take the place of the previous event.
    previous = F.last("ts", ignorenulls=True).over(
        S.over_slices(key, F.asc_nulls_first("ts"), tiebreak).rowsBetween(Window.unboundedPreceding, -1))
    running = S.over_slices(key, F.asc("_own"), *order, more=["_action"]).rowsBetween(Window.unboundedPreceding, 0)
    done = S.own(counted.withColumn("_prev", previous).withColumn("eventTypeCount", F.sum("_one").over(running)))
    interval = F.unix_millis("ts") - F.unix_millis("_prev")
    return (done.withColumn("lastProcessingInterval", F.coalesce(interval, F.lit(0)))
            .drop("_prev", "_one", "_action"))


def dedupe(df: DataFrame, key: str, order: list[str], ts: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """The first row of each id. Map tasks keep one row per id; a stream drops repeats within the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def count_batches(readings: DataFrame, size: int = 100, partial: bool = True) -> tuple[DataFrame, DataFrame]:
    """Batches of ``size`` readings per sensor type: (one summary per batch, readings with their batch's mean)."""
    order = ["ts", "readingId"]
    numbered = S.row_numbers(readings, ["sensorType"], _pos("ts"), order, "_no")
    batched = numbered.withColumn("batch", F.floor((F.col("_no") - 1) / size)).drop("_no")
    full = F.lit(True) if partial else F.col("batchSize") == size
    mean = F.coalesce(F.avg("value"), F.lit(0.0))
    summaries = (batched.groupBy("sensorType", "batch")
                 .agg(F.count(F.lit(1)).cast("int").alias("batchSize"), mean.alias("averageValue")).where(full))
    group = Window.partitionBy("sensorType", "batch")
    rows = (batched.withColumn("batchSize", F.count(F.lit(1)).over(group).cast("int"))
            .withColumn("batchAverage", F.coalesce(F.avg("value").over(group), F.lit(0.0))).where(full))
    return summaries, rows
