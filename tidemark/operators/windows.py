"""Event-time window aggregations. All but ``sensor_series`` and ``sensor_trend`` also run on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import late_filter, micros, seconds
from tidemark.operators import slicing as S


def _bounds() -> list[Column]:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def count_by_user_type(events: DataFrame, size: str = "1 minute") -> DataFrame:
    """Events per user and event type in tumbling windows."""
    return (events.groupBy(F.window("ts", size), "userId", "eventType").agg(F.count(F.lit(1)).alias("count"))
            .select(F.concat_ws(":", "userId", "eventType").alias("key"), "userId", "eventType", "count",
                    *_bounds()))


def page_stats(events: DataFrame, size: str = "5 minutes", approximate: bool = False) -> DataFrame:
    """Views, distinct users and mean duration per page; events without a page do not count.

    Distinct users are counted in two steps, by (window, page, user) first, so that a page with a third of all views
    is spread over its users, on a stream (append mode) as well. ``approximate`` keeps a fixed-size sketch instead.
    """
    duration = F.col("duration")
    if dict(events.dtypes)["duration"] == "string":
        duration = F.when(duration.rlike("^[+-]?[0-9]{1,18}$"), duration.try_cast("bigint"))
    seen = late_filter(events, F.col("page").isNotNull()).select("ts", "page", "userId", duration.alias("_d"))
    window = F.window("ts", size).alias("window")
    if approximate:
        counted = seen.groupBy(window, "page").agg(
            F.count(F.lit(1)).alias("pageViews"), F.approx_count_distinct("userId").alias("uniqueUsers"),
            F.sum("_d").alias("_sum"), F.count("_d").alias("_n"))
    else:
        per_user = seen.groupBy(window, "page", "userId").agg(
            F.count(F.lit(1)).alias("_views"), F.sum("_d").alias("_sum"), F.count("_d").alias("_n"))
        again = F.window("window", size).alias("window") if events.isStreaming else F.col("window")
        counted = per_user.groupBy(again, "page").agg(
            F.sum("_views").alias("pageViews"), F.count("userId").alias("uniqueUsers"),
            F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    mean = F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0))
    return counted.select("page", "pageViews", "uniqueUsers", mean.alias("avgDuration"), *_bounds())


def event_rate(events: DataFrame, size: str = "10 seconds") -> DataFrame:
    """All events per window and whole events per second; partial counts keep the single group small."""
    whole = max(int(seconds(size)), 1)
    return (events.groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("totalEvents"))
            .select("totalEvents", F.floor(F.col("totalEvents") / whole).alias("eventsPerSecond"), *_bounds()))


def sensor_stats(sensors: DataFrame, size: str = "5 minutes", label: str = "tumbling_5min") -> DataFrame:
    """Count, sum, mean and minimum of the readings per sensor type."""
    return (sensors.groupBy(F.window("ts", size), "sensorType")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"),
                 F.avg("value").alias("average"), F.min("value").alias("minimum"))
            .select("sensorType", *_bounds(), "count", "sum", "average", "minimum",
                    F.lit(label).alias("aggregationType")))


def slope(n: Column, sum_y: Column, sum_xy: Column) -> Column:
    """Least-squares slope of values over the indexes 0 to n-1."""
    n = n.cast("double")
    sum_x = n * (n - 1) / 2
    sum_x2 = (n - 1) * n * (2 * n - 1) / 6
    return (n * sum_xy - sum_x * sum_y) / (n * sum_x2 - sum_x * sum_x)


def trend_direction(trend: Column) -> Column:
    return F.when(trend > 0, "INCREASING").when(trend < 0, "DECREASING").otherwise("STABLE")


def sensor_trend(sensors: DataFrame, size: str = "10 minutes", slide: str = "2 minutes",
                 label: str = "sliding_10min_2min", slice_width: str | None = None) -> DataFrame:
    """Slope of the readings over their index, per sensor type in sliding windows of two readings or more.

    Readings are numbered inside blocks of each type, never across a whole window: a block gives its count,
    its sum and its sum of index times value, and the blocks of a window combine exactly in their order, since shifting
    all indexes by ``m`` adds ``m`` times the sum. Rows are therefore not copied into the windows they belong to. Blocks are
    as wide as ``slice_width``; those of a type with too many rows for one task are cut further by density.
    """
    step, span = micros(slide), micros(size)
    width = micros(slice_width) if slice_width else step
    if step % width or span % width:
        raise ValueError("the slices must divide the slide and the window")
    narrow = sensors.select("sensorType", "value", "ts", "readingId", F.floor(F.unix_micros("ts") / width).alias("_at"))
    placed = S.place(narrow, ["sensorType"], F.unix_micros("ts")).rows
    block = ["sensorType", "_at", "_slice"]
    numbered = placed.withColumn("_i", F.row_number().over(Window.partitionBy(*block).orderBy("ts", "readingId")) - 1)
    blocks = numbered.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_y"), F.sum(F.col("_i") * F.col("value")).alias("_iy"))
    begin = F.col("_at") * width
    first = F.floor((begin - span) / step) + 1
    starts = F.sequence(first * step, F.floor(begin / step) * step, F.lit(step))
    copied = blocks.withColumn("_start", F.explode(starts))
    ahead = (Window.partitionBy("sensorType", "_start").orderBy("_at", "_slice")
             .rowsBetween(Window.unboundedPreceding, -1))
    shifted = copied.withColumn("_m", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    total = shifted.groupBy("sensorType", "_start").agg(
        F.sum("_n").alias("_n"), F.sum("_y").alias("_y"),
        F.sum(F.col("_iy") + F.col("_m") * F.col("_y")).alias("_xy"))
    trend = slope(F.col("_n"), F.col("_y"), F.col("_xy"))
    return (total.where(F.col("_n") >= 2).withColumn("trend", trend)
            .select("sensorType", F.timestamp_micros("_start").alias("window_start"),
                    F.timestamp_micros(F.col("_start") + span).alias("window_end"),
                    F.col("_n").cast("int").alias("dataPoints"), "trend",
                    trend_direction(F.col("trend")).alias("trendDirection"),
                    F.lit(label).alias("aggregationType")))


def sensor_trend_stream(sensors: DataFrame, size: str = "10 minutes", slide: str = "2 minutes",
                        label: str = "sliding_10min_2min", slice_width: str = "10 seconds") -> DataFrame:
    """The same on a stream, where row numbers are not available: the state holds the readings of open slices, and
    of open windows only one summary per slice. Runs in append mode."""
    if micros(slide) % micros(slice_width) or micros(size) % micros(slice_width):
        raise ValueError("the slices must divide the slide and the window")

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    values = F.transform(F.col("_r"), lambda r: r["value"])
    slices = sensors.groupBy(F.window("ts", slice_width), "sensorType").agg(
        F.sort_array(F.collect_list(F.struct("ts", "readingId", "value"))).alias("_r")).select(
        "window", "sensorType", F.struct(
            F.col("window.start").alias("begin"), F.size("_r").cast("bigint").alias("n"), total(values).alias("y"),
            total(F.transform(values, lambda v, i: v * i)).alias("iy")).alias("_slice"))
    grouped = slices.groupBy(F.window("window", size, slide), "sensorType").agg(
        F.sort_array(F.collect_list("_slice")).alias("_slices"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("y"), F.lit(0.0).alias("xy"))
    joined = F.aggregate("_slices", none, lambda a, s: F.struct(
        (a["n"] + s["n"]).alias("n"), (a["y"] + s["y"]).alias("y"),
        (a["xy"] + s["iy"] + a["n"] * s["y"]).alias("xy")))
    return (grouped.withColumn("_t", joined).where(F.col("_t.n") >= 2)
            .withColumn("trend", slope(F.col("_t.n"), F.col("_t.y"), F.col("_t.xy")))
            .select("sensorType", *_bounds(), F.col("_t.n").cast("int").alias("dataPoints"), "trend",
                    trend_direction(F.col("trend")).alias("trendDirection"),
                    F.lit(label).alias("aggregationType")))


def deviation_candidates(sensors: DataFrame, size: str = "1 minute", sensor_type: str = "temperature",
                         min_readings: int = 2, limit: float = 5.0) -> DataFrame:
    """Per location and window, the reading farthest from the mean where it is farther than ``limit``.

    The farthest reading is always the smallest or the largest, so mean, smallest and largest are enough; equal
    deviations go to the smaller sensor id, then the smaller reading id.
    """
    low_rank = F.struct(F.col("value"), F.col("sensorId"), F.col("readingId"))
    high_rank = F.struct((-F.col("value")).alias("v"), F.col("sensorId"), F.col("readingId"))
    kept = ["sensorId", "readingId", "value", "ts", *(["unit"] if "unit" in sensors.columns else [])]
    found = (late_filter(sensors, F.col("sensorType") == sensor_type)
             .groupBy(F.window("ts", size), "location", "sensorType")
             .agg(F.count(F.lit(1)).alias("readings"), F.avg("value").alias("mean"),
                  F.min_by(F.struct(*kept), low_rank).alias("_low"),
                  F.min_by(F.struct(*kept), high_rank).alias("_high")))
    below, above = F.col("mean") - F.col("_low.value"), F.col("_high.value") - F.col("mean")
    # The two deviations of a pair are equal but for rounding.
    even = F.abs(above - below) <= 1e-9
    pick_low = F.when(even, F.struct("_low.sensorId", "_low.readingId")
                      <= F.struct("_high.sensorId", "_high.readingId")).otherwise(below > above)
    return (found.withColumn("deviation", F.greatest(below, above))
            .where((F.col("readings") >= min_readings) & (F.col("deviation") > limit))
            .withColumn("_far", F.when(pick_low, F.col("_low")).otherwise(F.col("_high")))
            .select("location", "sensorType", *_bounds(), "readings", "mean", "deviation",
                    *[f"_far.{c}" for c in kept],
                    F.least(F.lit(0.9), F.col("deviation") / 10).alias("severity")))


def topic_stats(messages: DataFrame, size: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Messages per topic and window with the window's total and rate (one decimal).

    A stream sums its counts up in a second aggregation, which holds one entry per topic, and so runs in append mode."""
    by_topic = (messages.groupBy(F.window(ts, size), "topic").agg(F.count(F.lit(1)).alias("messages")))
    if messages.isStreaming:
        whole = (by_topic.groupBy(F.window("window", size)).agg(
            F.sum("messages").alias("totalMessages"), F.collect_list(F.struct("topic", "messages")).alias("_topics"))
            .select("*", F.inline("_topics")))
        return whole.select("topic", "messages", *_bounds(), "totalMessages",
                            F.round(F.col("totalMessages") / seconds(size), 1).alias("messagesPerSecond"))
    total = F.sum("messages").over(Window.partitionBy("window"))
    return by_topic.select(
        "topic", "messages", *_bounds(), total.alias("totalMessages"),
        F.round(total / seconds(size), 1).alias("messagesPerSecond"))


def rate_series(messages: DataFrame, size: str = "1 second", last: int = 60) -> DataFrame:
    """Events per second and share of frauds among transactions, both to two decimals, newest buckets first."""
    is_tx = F.col("kind") == "transaction"
    share = F.try_divide(100.0 * F.count_if(is_tx & F.col("isFraud")), F.count_if(is_tx))
    grouped = messages.groupBy(F.window("ts", size)).agg(
        F.round(F.count(F.lit(1)) / seconds(size), 2).alias("eventsPerSecond"),
        F.round(F.coalesce(share, F.lit(0.0)), 2).alias("fraudRate")).select(
        *_bounds(), "eventsPerSecond", "fraudRate")
    return grouped if messages.isStreaming else grouped.orderBy(F.desc("window_start")).limit(last)


def sensor_series(sensors: DataFrame, last: int = 100) -> DataFrame:
    """The newest readings of each location and sensor type; map tasks keep only ``last`` per group."""
    newest = Window.partitionBy("location", "sensorType").orderBy(F.desc("ts"), F.desc("readingId"))
    return (sensors.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= last)
            .select(F.concat_ws("_", "location", "sensorType").alias("series"), "position", "ts", "value",
                    F.col("sensorId").alias("label")))


def all_kinds(users: DataFrame, tx: DataFrame, sensors: DataFrame) -> DataFrame:
    """The three kinds as one narrow table: kind, time and the two flags."""
    no = F.lit(False)
    return (users.select(F.lit("user").alias("kind"), "ts", no.alias("isFraud"), no.alias("isAnomaly"))
            .unionByName(tx.select(F.lit("transaction").alias("kind"), "ts", "isFraud", no.alias("isAnomaly")))
            .unionByName(sensors.select(F.lit("iot").alias("kind"), "ts", no.alias("isFraud"), "isAnomaly")))


def running_counters(messages: DataFrame) -> DataFrame:
    """Totals by kind with the fraud rate in percent (one decimal)."""
    kind = F.col("kind")
    counted = messages.groupBy().agg(
        F.count_if(kind == "user").alias("userEvents"), F.count_if(kind == "transaction").alias("transactions"),
        F.count_if(kind == "iot").alias("iotEvents"), F.count_if("isFraud").alias("frauds"),
        F.count_if("isAnomaly").alias("anomalies"), F.count(F.lit(1)).alias("total"))
    rate = F.coalesce(F.try_divide(100.0 * F.col("frauds"), F.col("transactions")), F.lit(0.0))
    return counted.withColumn("fraudRate", F.round(rate, 1))


def throughput_status(stats: DataFrame, value: str, active: float = 50, warning: float = 10) -> DataFrame:
    """``active``, ``warning`` or ``inactive`` by throughput."""
    v = F.col(value)
    return stats.withColumn("status", F.when(v > active, "active").when(v > warning, "warning").otherwise("inactive"))
