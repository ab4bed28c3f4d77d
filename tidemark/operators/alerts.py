"""Alert rows, and all fraud or anomaly detectors in one pass over their input."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.fixed_values import ALERT_SOURCES, ALERT_STATUS, ALERT_TEXTS
from tidemark.functions.times import is_off_hours, micros
from tidemark.operators import keyed as K
from tidemark.operators import patterns as P
from tidemark.operators import slicing as S
from tidemark.operators import windows as W


def alert(kind: str, source: str, key: Column, at: Column, description: Column, severity: Column, **details: Column) -> Column:
    """An alert as a struct. Its id is a digest of type, key and time, so repeated runs give the same alert."""
    text = F.concat_ws("|", F.lit(kind), key, F.unix_millis(at).cast("string"))
    return F.struct(
        F.sha2(text, 256).alias("alertId"), at.alias("ts"), F.lit(kind).alias("alertType"),
        *[c.alias(n) for n, c in details.items()], F.lit(ALERT_TEXTS[kind][0]).alias("title"),
        description.alias("description"), severity.cast("double").alias("severity"),
        F.lit(ALERT_STATUS).alias("status"), F.lit(ALERT_SOURCES[source]).alias("source"))


def describe(kind: str, *values: Column | float) -> Column:
    """An alert's description. Numbers are rounded first, so that the order of summing cannot show in the text."""
    whole = [v if isinstance(v, Column) else F.lit(v) for v in values]
    kinds = re.findall(r"%(?:\.\d)?([dfs])", ALERT_TEXTS[kind][1])
    return F.format_string(ALERT_TEXTS[kind][1], *[F.round(v, 6) if k == "f" else v for v, k in zip(whole, kinds)])


def _emit(df: DataFrame, alerts: list[tuple[Column, Column]]) -> DataFrame:
    """The alerts whose condition holds, one row each."""
    found = F.filter(F.array(*[F.when(cond, a) for cond, a in alerts]), lambda a: a.isNotNull())
    return df.select(F.explode(found).alias("a")).select("a.*")


def fraud_alerts(tx: DataFrame, velocity_within: str = "2 minutes", velocity_n: int = 5, high: float = 1000,
                 low: float = 100, small_n: int = 3, structuring_within: str = "10 minutes",
                 country_within: str = "5 minutes", failed_n: int = 3, testing_within: str = "5 minutes",
                 risk: float = 0.7, tz: str = "UTC", success: tuple[str, ...] = ("completed",),
                 failure: tuple[str, ...] = ("failed",)) -> DataFrame:
    """All five fraud detectors over one scan and one shuffle by user.

    An alert carries the transaction its pattern started with; card testing carries the successful one at the end.
    """
    spans = [micros(s) for s in (velocity_within, structuring_within, country_within, testing_within)]
    narrow = tx.select("userId", "transactionId", "ts", "amount", "status", "country", "riskScore")
    narrow = narrow.where(F.col("status").isin(*success, *failure))
    key = ["userId"]
    placed = S.place(narrow, key, F.unix_micros("ts"))
    found = {"_v": (P.velocity_stages(velocity_n, success), spans[0]),
             "_s": (P.structuring_stages(high, low, small_n, success), spans[1]),
             "_t": (P.card_testing_stages(failed_n, success, failure), spans[3])}
    done = F.col("status").isin(*success)
    with_country = done & F.col("country").isNotNull()
    quiet = placed if placed.busy is None else placed.with_rows(placed.rows.where("NOT _hot"))
    work = S.by_slice(quiet)
    for name, (stages, span) in found.items():
        work = P.add_matches(work, stages, span, key, "transactionId", "amount", name)
    work = work.withColumn("_done", with_country)
    following = F.lead(F.struct("ts", "country")).over(S.over_slices(key, "ts", "transactionId", more=["_done"]))
    kept = [*narrow.columns, *found, "_c"]
    seen = work.withColumn("_c", F.when(F.col("_done"), following)).select(*kept)
    if placed.busy is not None:
        ranked = P.rank_rows(placed, {name: stages for name, (stages, _) in found.items()}, key, "transactionId", {"_done": with_country})
        hot = ranked
        for name, (stages, span) in found.items():
            hot = P.by_seq(hot, P.matches_by_rank(ranked, stages, span, key, "transactionId", "amount", name), key)
        nexts = ranked.where("_done_is").select(F.col("userId").alias("_user"), F.col("_done").alias("_no"), F.struct("ts", "country").alias("_c"))
        same = hot["userId"].eqNullSafe(nexts["_user"]) & F.col("_done_is") & (hot["_done"] + 1 == nexts["_no"])
        seen = seen.unionByName(hot.join(nexts, same, "left").select(*kept))
    travelled = ((F.unix_micros("_c.ts") - F.unix_micros("ts") < spans[2]) & (F.col("_c.country") != F.col("country")))

    def fraud(kind: str, severity: Column, *said: Column | float, tx_id: Column = F.col("transactionId")) -> Column:
        return alert(kind, "fraud", tx_id, F.col("ts"), describe(kind, *said), severity, userId=F.col("userId"), transactionId=tx_id)

    amount, minutes = F.col("amount"), 60_000_000
    return _emit(seen, [
        (F.col("_v").isNotNull(), fraud("VELOCITY_FRAUD", F.lit(0.9), velocity_n, F.col("_v.totals")[0], spans[0] // minutes)),
        (F.col("_s").isNotNull(), fraud("STRUCTURING_FRAUD", F.lit(0.8), amount, small_n, F.col("_s.totals")[1])),
        (travelled, fraud("GEOGRAPHIC_ANOMALY", F.lit(0.7), F.col("country"), F.col("_c.country"), spans[2] // minutes)),
        (F.col("_t").isNotNull(), fraud("TESTING_ATTACK", F.lit(0.85), failed_n, F.col("_t.totals")[1], tx_id=F.col("_t.id"))),
        (done & is_off_hours(F.col("ts"), tz) & (F.col("riskScore") >= risk), off_hours_alert()),
    ])


def off_hours_alert() -> Column:
    risk, at = F.col("riskScore"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSX")
    return alert("OFF_HOURS_HIGH_RISK", "fraud", F.col("transactionId"), F.col("ts"),
                 describe("OFF_HOURS_HIGH_RISK", F.col("amount"), risk, at), risk,
                 userId=F.col("userId"), transactionId=F.col("transactionId"))


def sensor_alert(kind: str, severity: Column, *said: Column | float, at: Column | None = None, row: str = "") -> Column:
    """An alert about a reading, whose columns lie at ``row``; an offline sensor has no reading to tell of.

    The alert's id is made of sensor and reading, so that two readings of one sensor in one millisecond have alerts of their own."""

    def field(name: str, otherwise: Column) -> Column:
        return otherwise if kind == "SENSOR_OFFLINE" else F.col(f"{row}{name}")

    about = F.concat_ws("|", F.col("sensorId"), field("readingId", F.lit(None)).cast("string"))
    return alert(kind, "anomaly", about, F.col(f"{row}ts") if at is None else at, describe(kind, *said), severity,
                 sensorId=F.col("sensorId"), deviceType=field("sensorType", F.lit("UNKNOWN")),
                 location=field("location", F.lit("UNKNOWN")), value=field("value", F.lit(0.0)),
                 unit=field("unit", F.lit(None).cast("string")), readingTimestamp=field("ts", F.lit(None).cast("timestamp")))


def with_unit(readings: DataFrame) -> DataFrame:
    return readings if "unit" in readings.columns else readings.withColumn("unit", F.lit(None).cast("string"))


def anomaly_alerts(readings: DataFrame, n: int = 100, min_n: int = 10, z: float = 2.5, max_dt: str = "300 seconds",
                   rel: float = 0.5, timeout: str = "5 minutes", delay: str = "10 seconds",
                   deviation_window: str = "1 minute", deviation: float = 5.0,
                   limits: DataFrame | None = None) -> DataFrame:
    """All sensor detectors: z-score, threshold, rapid change, gap and offline in one pass by sensor, and
    deviation within a location."""
    order, span, silence = ["ts", "readingId"], micros(max_dt), micros(timeout)
    limits = F.broadcast(scoring.alert_limits(readings.sparkSession)) if limits is None else limits
    readings = with_unit(readings)
    columns = [*order, "sensorId", "sensorType", "location", "value", "unit"]
    placed = S.place(readings.select(*columns), ["sensorId"], F.unix_micros("ts"))
    seen = S.last_rows(placed, order, "value", n)
    met = seen.join(limits, F.lower(seen["sensorType"]) == limits["limitType"], "left")
    value, elapsed = F.col("value"), F.unix_micros("ts") - F.unix_micros("_prev.ts")
    score = F.when((F.col("_n") >= min_n) & (F.col("_std") > 0), F.col("_off") / F.col("_std"))
    change = F.when((elapsed > 0) & (elapsed < span), K.relative_change(value, F.col("_prev.value")))
    scored = met.withColumns({"_z": score, "_rel": change, "_gap": elapsed})

    def offline_at(last_seen: Column) -> Column:
        return sensor_alert("SENSOR_OFFLINE", F.lit(0.8), silence / 60_000_000.0, at=F.timestamp_micros(F.unix_micros(last_seen) + silence))

    by_row = _emit(scored, [
        (F.col("_z") > z, sensor_alert("STATISTICAL_ANOMALY", F.least(F.lit(0.9), F.col("_z") / z), value, F.col("_z"), F.col("_mean"))),
        ((value < F.col("lowLimit")) | (value > F.col("highLimit")), sensor_alert(
            "THRESHOLD_VIOLATION", scoring.threshold_severity(F.col("sensorType"), value, F.col("lowLimit"), F.col("highLimit")),
            F.col("sensorType"), value, F.coalesce("unit", F.lit("")))),
        (F.col("_rel") > rel, sensor_alert("RAPID_CHANGE", F.least(F.lit(0.9), F.col("_rel")), F.col("_rel") * 100,
                                      F.col("_prev.value"), value, F.col("_gap") / 1e6)),
        # rounded once, to the digit that the text shows
        (F.col("_gap") > silence, sensor_alert("MISSING_DATA", F.lit(0.7), F.round(F.col("_gap") / 60_000_000.0, 1))),
        (F.col("_gap") > silence, offline_at(F.col("_prev.ts"))),
    ])
    horizon = K._horizon(placed, delay)
    newest = readings.groupBy("sensorId").agg(
        F.max("ts").alias("ts"), F.lit(None).cast("string").alias("sensorType"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
    silent = _emit(newest.where(F.unix_micros("ts") + silence <= horizon), [(F.lit(True), offline_at(F.col("ts")))])
    apart = W.deviation_candidates(readings, deviation_window, limit=deviation)
    crossed = _emit(apart, [(F.lit(True), sensor_alert("CORRELATION_ANOMALY", F.col("severity"), value, F.col("deviation"), F.col("mean")))])
    return by_row.unionByName(silent).unionByName(crossed)
