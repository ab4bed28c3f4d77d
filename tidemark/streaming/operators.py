"""Streaming forms of the operators that need state; all others take a stream as they take a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import is_off_hours, micros
from tidemark.operators import alerts as A
from tidemark.operators import windows as W
from tidemark.operators.enrich import scored, threshold_violations
from tidemark.operators.patterns import Stage, card_testing_stages, structuring_stages, velocity_stages
from tidemark.streaming import rules as R
from tidemark.streaming.ordered import in_order
from tidemark.streaming.profiles import Profiles
from tidemark.streaming.slices import FullBatches, in_slices


def _times(df: DataFrame, **names: str) -> DataFrame:
    """Microsecond columns as timestamps under new names."""
    for old, new in names.items():
        df = df.withColumn(old, F.timestamp_micros(old)).withColumnRenamed(old, new)
    return df


def sessions(events: DataFrame, gap: str = "30 minutes", tiebreak: str = "eventId", **options: str) -> DataFrame:
    out = in_order(events, "userId", R.Sessions(micros(gap)), tiebreak, **options)
    duration = F.floor(F.col("last") / 1000) - F.floor(F.col("start") / 1000)
    return _times(out.withColumn("duration", duration), start="sessionStart", last="sessionEnd")


def zscore_alerts(readings: DataFrame, n: int = 100, min_n: int = 10, z: float = 2.5, **options: str) -> DataFrame:
    out = in_order(readings, "sensorId", R.ZScore(n, min_n, z), "readingId", **options)
    return _times(out.withColumn("severity", F.least(F.lit(0.9), F.col("zScore") / z)), p="ts")


def rapid_change(readings: DataFrame, max_dt: str = "300 seconds", rel: float = 0.5, **options: str) -> DataFrame:
    out = in_order(readings, "sensorId", R.RapidChange(micros(max_dt), rel), "readingId", **options)
    return _times(out.withColumn("severity", F.least(F.lit(0.9), F.col("relativeChange"))), p="ts")


def data_gaps(readings: DataFrame, timeout: str = "5 minutes", **options: str) -> DataFrame:
    return _times(in_order(readings, "sensorId", R.DataGaps(micros(timeout)), "readingId", **options), p="ts")


def offline(readings: DataFrame, timeout: str = "5 minutes", **options: str) -> DataFrame:
    out = in_order(readings, "sensorId", R.Offline(micros(timeout)), "readingId", **options)
    return _times(out, p="ts", lastSeen="lastSeenTs").withColumnRenamed("lastSeenTs", "lastSeen")


def velocity_count(tx: DataFrame, window: str = "300 seconds", more_than: int = 5, **options: str) -> DataFrame:
    return _times(in_order(tx, "userId", R.VelocityCount(micros(window), more_than), "transactionId", **options), p="ts")


def rate_limit(tx: DataFrame, per: str = "1 minute", n: int = 100, **options: str) -> DataFrame:
    return _times(in_order(tx, "userId", R.RateLimit(micros(per), n), "transactionId", **options), p="ts")


def running_stats(events: DataFrame, action: str = "action", forget: str | None = "24 hours", live: str | None = None,
                  **options: str) -> DataFrame:
    """``live``: how long an action's count outlives its last event; the table form keeps all, as None does."""
    rule = R.RunningStats(micros(live) if live else None)
    return _times(in_order(events, "userId", rule, "eventId", forget=forget, action=F.col(action), **options), p="ts")


def count_batches(readings: DataFrame, size: int = 100, timeout: str | None = None, width: str | None = None,
                  **options: str) -> DataFrame:
    """Batches of ``size`` readings per type. With ``width`` a type's readings are spread over tasks by slices of time, whose
    counts number them on, and a batch is put together from the slices it reaches over; a last batch that is not full waits."""
    if width is not None:
        if timeout is not None:
            raise ValueError("batches of spread keys have no timeout")
        numbered = in_slices(readings, "sensorType", R.Numbered(size), R.Counted(), F.count(F.lit(1)), "readingId", width, **options)
        kind = dict(numbered.dtypes)["sensorType"]
        output = T.StructType.fromDDL(f"sensorType {kind}, {R.CountBatches.output}")
        return numbered.groupBy("sensorType", "batch").transformWithState(FullBatches(size, output.names), output, "Append", "None")
    rule = R.CountBatches(size, micros(timeout) if timeout else None)
    return in_order(readings, "sensorType", rule, "readingId", **options)


def sequence(df: DataFrame, stages: list[Stage], within: str, key: str, tiebreak: str, amount: str = "amount",
             **options: str) -> DataFrame:
    """Matches as (startId, startTs, endId, endTs, totals per stage); rows of no stage are dropped beforehand."""
    flags = F.array(*[F.coalesce(s.cond, F.lit(False)) for s in stages])
    rule = R.Sequence([s.times for s in stages], micros(within))
    out = in_order(df, key, rule, F.col(tiebreak).cast("string"), where=F.array_contains(flags, True), flags=flags,
                   amount=F.col(amount).cast("double"), **options)
    return _times(out, startP="startTs", endP="endTs")


def velocity(tx: DataFrame, n: int = 5, within: str = "2 minutes", **options: str) -> DataFrame:
    return sequence(tx, velocity_stages(n), within, "userId", "transactionId", **options)


def structuring(tx: DataFrame, high: float = 1000, low: float = 100, n: int = 3, within: str = "10 minutes",
                **options: str) -> DataFrame:
    return sequence(tx, structuring_stages(high, low, n), within, "userId", "transactionId", **options)


def card_testing(tx: DataFrame, n: int = 3, within: str = "5 minutes", **options: str) -> DataFrame:
    return sequence(tx, card_testing_stages(n), within, "userId", "transactionId", **options)


def country_change(tx: DataFrame, within: str = "5 minutes", success: tuple[str, ...] = ("completed",),
                   **options: str) -> DataFrame:
    done = F.col("status").isin(*success) & F.col("country").isNotNull()
    out = in_order(tx, "userId", R.CountryChange(micros(within)), "transactionId", where=done, **options)
    return _times(out, p="startTs", endP="endTs")


def asof_join(left: DataFrame, right: DataFrame, key: str, name: str, right_id: str, ts: str = "ts",
              tolerance: str | None = None, how: str = "inner", width: str | None = None, **options: str) -> DataFrame:
    """Each left row with the latest right row of its key, no older than ``tolerance``, as struct ``name``; both streams
    share one watermark. With ``width`` a key's rows are spread over tasks by slices of time, for keys that are few."""
    left_kinds, right_kinds = dict(left.dtypes), dict(right.dtypes)
    lefts, rights = _numbers(left), _numbers(right)
    no_id = F.lit(None).cast(right.schema[right_id].dataType)
    no_left, no_right = F.lit(None).cast(lefts.schema), F.lit(None).cast(rights.schema)

    def side(df: DataFrame, number: int, ident: Column, pair: tuple[Column, Column]) -> DataFrame:
        return df.select(
            F.col(key).alias("_key"), F.col(ts).alias("_ts"),
            F.struct(F.lit(number).alias("side"), ident.alias("id")).alias("_side"),
            F.struct(pair[0].alias("leftRow"), pair[1].alias("rightRow")).alias("payload"))

    both = side(left, 1, no_id, (_number_row(left), no_right)).unionByName(
        side(right, 0, F.col(right_id), (no_left, _number_row(right))))
    rule = R.AsOf(lefts.schema.simpleString(), rights.schema.simpleString(), how == "inner", micros(tolerance) if tolerance else None)
    if width is None:
        out = in_order(both, "_key", rule, "_side", ts="_ts", **options)
    else:
        is_right = F.col("_id.side") == 0
        latest = F.max_by(F.when(is_right, F.struct(F.col("payload.rightRow").alias("hit"), F.col("_p").alias("p"))),
                          F.when(is_right, F.struct("_p", "_id.id")))
        out = in_slices(both.withColumnRenamed("_key", "of"), "of", rule, R.LatestHit(), latest, "_side", width, ts="_ts", **options)
    hit = F.when(F.col("hit").isNotNull(), F.struct(*[_back(f"hit.{c}", k).alias(c) for c, k in right_kinds.items()]))
    return out.select(*[_back(f"leftRow.{c}", k).alias(c) for c, k in left_kinds.items()], hit.alias(name))


# State keeps times as numbers: Python would read them in the zone of each worker.
def _number(c: str, kind: str) -> Column:
    return F.unix_micros(c).alias(c) if kind == "timestamp" else F.col(c)


def _numbers(df: DataFrame) -> DataFrame:
    return df.select(*[_number(c, k) for c, k in df.dtypes])


def _number_row(df: DataFrame) -> Column:
    return F.struct(*[_number(c, k) for c, k in df.dtypes])


def _back(c: str, kind: str) -> Column:
    return F.timestamp_micros(c) if kind == "timestamp" else F.col(c)


def profile_lookup(df: DataFrame, profiles: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Every row with its key's profile, as ``joins.lookup`` gives it, and ``profileKnown``: false for the row at which a profile was
    created from ``defaults``.

    ``profiles`` is read once, when the stream starts without a checkpoint, and lies in the state by key; nothing is
    broadcast, and a restart finds created profiles again. Of several profiles of one key the least counts. Rows without a
    key have the profile of that key, if any. All rows of a key pass through one task, one trigger's rows at a time.
    """
    known = [c for c in profiles.columns if c != key]
    kinds = {c: k for c, k in df.dtypes if c != key}
    mine = dict(_numbers(profiles.select(*known)).dtypes)
    first = _numbers(profiles).groupBy(key).agg(F.min(F.struct(*known)).alias("_p")).select(key, *[F.col("_p")[c].alias(c) for c in known])
    work = _numbers(df.select(key, *kinds))
    rows = ", ".join(f"`{c}` {k}" for c, k in work.dtypes)
    own = ", ".join(f"`{c}` {k}" for c, k in mine.items())
    output = T.StructType.fromDDL(f"{rows}, {own}, profileKnown BOOLEAN")
    processor = Profiles(list(kinds), known, defaults, own, output.names)
    out = work.groupBy(key).transformWithState(processor, output, "Append", "None", initialState=first.groupBy(key))
    back = {**kinds, **{c: k for c, k in profiles.dtypes if c != key}}
    return out.select(key, *[_back(c, k).alias(c) for c, k in back.items()], "profileKnown")


def risk_score(tx: DataFrame, risky_countries: list[str] | None = None, categories: int = 3, **options: str) -> DataFrame:
    """Score and decision of every transaction from what its user did before, as of a table."""
    if "paymentMethod" not in tx.columns:
        tx = tx.withColumn("paymentMethod", F.lit(None).cast("string"))
    known = _times(in_order(tx, "userId", R.Profile(categories), "transactionId", **options), p="ts")
    return scored(known, risky_countries).drop("elapsed", "averageAmount", "homeCountry", "usualCategory")


def fraud_alerts(tx: DataFrame, velocity_within: str = "2 minutes", velocity_n: int = 5, high: float = 1000,
                 low: float = 100, small_n: int = 3, structuring_within: str = "10 minutes",
                 country_within: str = "5 minutes", failed_n: int = 3, testing_within: str = "5 minutes",
                 risk: float = 0.7, tz: str = "UTC", success: tuple[str, ...] = ("completed",),
                 failure: tuple[str, ...] = ("failed",), **options: str) -> DataFrame:
    """The alert rows of all five detectors, as of a table; four share one state per user."""
    done = F.col("status").isin(*success)
    each = [velocity_stages(velocity_n, success), structuring_stages(high, low, small_n, success),
            card_testing_stages(failed_n, success, failure)]
    spans = [micros(s) for s in (velocity_within, structuring_within, testing_within)]
    flags = [F.array(*[F.coalesce(s.cond, F.lit(False)) for s in stages]) for stages in each]
    parts = [(R.Sequence([s.times for s in stages], span), [f"flags{i}", "amount"])
             for i, (stages, span) in enumerate(zip(each, spans))]
    parts.append((R.CountryChange(micros(country_within)), ["country"]))
    use = F.array(*[F.array_contains(f, True) for f in flags], done & F.col("country").isNotNull())
    found = in_order(tx, "userId", R.Together(parts), "transactionId", where=F.array_contains(use, True), use=use,
                     **{f"flags{i}": f for i, f in enumerate(flags)}, **options)

    def fraud(kind: str, hit: str, ident: str, at: str, severity: float, *said: Column | float) -> Column:
        tx_id = F.col(f"{hit}.{ident}")
        made = A.alert(kind, "fraud", tx_id, F.timestamp_micros(f"{hit}.{at}"), A.describe(kind, *said), F.lit(severity),
                       userId=F.col("userId"), transactionId=tx_id)
        return F.when(F.col(hit).isNotNull(), made)

    first, rest = [[F.col(f"o{i}.totals")[k] for i in range(3)] for k in (0, 1)]
    hit = F.coalesce(
        fraud("VELOCITY_FRAUD", "o0", "startId", "startP", 0.9, velocity_n, first[0], spans[0] // 60_000_000),
        fraud("STRUCTURING_FRAUD", "o1", "startId", "startP", 0.8, first[1], small_n, rest[1]),
        fraud("TESTING_ATTACK", "o2", "endId", "startP", 0.85, failed_n, rest[2]),
        fraud("GEOGRAPHIC_ANOMALY", "o3", "transactionId", "p", 0.7, F.col("o3.country"), F.col("o3.nextCountry"),
              micros(country_within) // 60_000_000))
    night = tx.where(is_off_hours(F.col("ts"), tz) & (F.col("riskScore") >= risk) & done)
    return found.select(hit.alias("a")).select("a.*").unionByName(night.select(A.off_hours_alert().alias("a")).select("a.*"))


def anomaly_alerts(readings: DataFrame, n: int = 100, min_n: int = 10, z: float = 2.5, max_dt: str = "300 seconds",
                   rel: float = 0.5, timeout: str = "5 minutes", deviation_window: str = "1 minute",
                   deviation: float = 5.0, delay: str = "10 seconds", **options: str) -> DataFrame:
    """The alert rows of all detectors, as of a table. Those per sensor share one state per sensor; deviations within a
    location are a windowed aggregation beside them, and limits need no state."""
    parts = [(R.ZScore(n, min_n, z), ["value"]), (R.RapidChange(micros(max_dt), rel), ["value"]),
             (R.DataGaps(micros(timeout)), []), (R.Offline(micros(timeout)), [])]
    readings = A.with_unit(readings)
    apart = W.deviation_candidates(readings.withWatermark("ts", delay), deviation_window, limit=deviation)
    readings = readings.withColumn("rowTs", F.col("ts"))
    carry = {"readingId": dict(readings.dtypes)["readingId"], "sensorType": "string", "location": "string", "value": "double", "unit": "string", "rowTs": "timestamp"}
    found = in_order(readings, "sensorId", R.Together(parts, carry), "readingId",
                     delay=delay, use=F.array(*[F.lit(True)] * len(parts)), **options)
    found = found.withColumn("row", F.struct("row.*", F.col("row.rowTs").alias("ts")))

    def hit(i: int, kind: str, severity: Column, *said: Column | float) -> Column:
        made = A.sensor_alert(kind, severity, *said, at=F.timestamp_micros(f"o{i}.p"), row="row.")
        return F.when(F.col(f"o{i}").isNotNull(), made)

    value = F.col("row.value")
    made = F.coalesce(
        hit(0, "STATISTICAL_ANOMALY", F.least(F.lit(0.9), F.col("o0.zScore") / z), value, F.col("o0.zScore"), F.col("o0.mean")),
        hit(1, "RAPID_CHANGE", F.least(F.lit(0.9), F.col("o1.relativeChange")), F.col("o1.relativeChange") * 100,
            F.col("o1.previousValue"), value, F.col("o1.seconds")),
        hit(2, "MISSING_DATA", F.lit(0.7), F.round("o2.minutes", 1)),
        hit(3, "SENSOR_OFFLINE", F.lit(0.8), micros(timeout) / 60_000_000.0))
    outside = threshold_violations(readings).select(A.sensor_alert(
        "THRESHOLD_VIOLATION", F.col("severity"), F.col("sensorType"), F.col("value"), F.coalesce("unit", F.lit(""))).alias("a"))
    crossed = apart.select(A.sensor_alert(
        "CORRELATION_ANOMALY", F.col("severity"), F.col("value"), F.col("deviation"), F.col("mean")).alias("a"))
    return (found.select(made.alias("a")).select("a.*").unionByName(outside.select("a.*")).unionByName(crossed.select("a.*")))
