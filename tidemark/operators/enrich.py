"""Enrichment: labels, limits and scores next to the fields they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import categories as C
from tidemark.functions import fixed_values as fixed
from tidemark.functions import scoring
from tidemark.functions.times import micros, time_parts
from tidemark.operators import slicing as S


def _add(df: DataFrame, columns: dict) -> DataFrame:
    return df.withColumns({**time_parts(F.col("ts")), **columns} if "ts" in df.columns else columns)


def enrich_user(df: DataFrame) -> DataFrame:
    """Calendar fields, event category, region and time zone, for the fields a table has."""
    out = {}
    if "eventType" in df.columns:
        out["eventCategory"] = C.event_category(F.col("eventType"))
    if "country" in df.columns:
        out.update(region=C.region(F.col("country")), timezone=C.timezone(F.col("country")))
    return _add(df, out)


def enrich_tx(df: DataFrame) -> DataFrame:
    """Calendar fields, risk and amount category, merchant type."""
    out = {}
    for source, name, label in (("riskScore", "riskCategory", C.risk_category),
                                ("amount", "amountCategory", C.amount_category),
                                ("merchantCategory", "merchantType", C.merchant_type)):
        if source in df.columns:
            out[name] = label(F.col(source))
    return _add(df, out)


def enrich_sensor(df: DataFrame) -> DataFrame:
    """Calendar fields, sensor and location category, value range, battery status."""
    out = {}
    if "sensorType" in df.columns:
        out["sensorCategory"] = C.sensor_category(F.col("sensorType"))
        if "value" in df.columns:
            out["valueRange"] = C.value_range(F.col("value"), F.col("sensorType"))
    if "location" in df.columns:
        out["locationCategory"] = C.location_category(F.col("location"))
    if "batteryLevel" in df.columns:
        out["batteryStatus"] = C.battery_status(F.col("batteryLevel"))
    return _add(df, out)


def threshold_violations(readings: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Readings outside the limits of their type, with severity. The limits are a small table of types."""
    limits = F.broadcast(scoring.alert_limits(readings.sparkSession)) if limits is None else limits
    met = readings.join(limits, F.lower(readings["sensorType"]) == limits["limitType"])
    outside = (F.col("value") < F.col("lowLimit")) | (F.col("value") > F.col("highLimit"))
    severity = scoring.threshold_severity(F.col("sensorType"), F.col("value"), F.col("lowLimit"), F.col("highLimit"))
    return met.where(outside).select(*readings.columns, "lowLimit", "highLimit", severity.alias("severity"))


def classify(readings: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Readings with ``normal``, ``out_of_range`` or ``critical`` by the ranges of their type."""
    ranges = F.broadcast(scoring.sensor_ranges(readings.sparkSession)) if ranges is None else ranges
    state = scoring.classify_reading(F.col("value"), (F.col("normalLow"), F.col("normalHigh")),
                                     (F.col("criticalLow"), F.col("criticalHigh")))
    return (readings.join(ranges, "sensorType", "left")
            .select(*readings.columns, F.col("rangeUnit").alias("unit"), state.alias("readingClass")))


def user_profiles(tx: DataFrame, categories: int = 3) -> DataFrame:
    """Mean amount, first country and most frequent merchant categories per user, all by partial aggregation."""
    by_category = tx.groupBy("userId", "merchantCategory").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_amount"),
        F.min(F.struct("ts", "transactionId", "country")).alias("_first"))
    # The map tasks drop what cannot be among the first categories.
    ranked = Window.partitionBy("userId").orderBy(F.desc("_n"), "merchantCategory")
    first = by_category.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= categories)
    preferred = first.groupBy("userId").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_r", "merchantCategory"))), lambda r: r["merchantCategory"]).alias("preferredCategories"))
    means = by_category.groupBy("userId").agg(
        F.try_divide(F.sum("_amount"), F.sum("_n")).alias("averageAmount"), F.min("_first")["country"].alias("homeCountry"))
    return means.join(preferred, means["userId"].eqNullSafe(preferred["userId"])).drop(preferred["userId"])


def earlier_profiles(tx: DataFrame, categories: int = 3) -> DataFrame:
    """Transactions with what was known of their user just before: ``averageAmount``, ``homeCountry`` (of the first
    transaction), ``usualCategory``, ``elapsed`` microseconds and ``priorFrauds``. All but the last are null for a user's first.

    A category is usual where fewer than ``categories`` others had been bought from more often. When a category comes to its
    m-th purchase, those that had m before are the ones that reached theirs earlier; so its place among all m-th purchases of
    the user tells, and no set of categories is held. Every m is a group of its own; for a hot user each slice settles
    all but its first few of every m, and only these meet.
    """
    key, order = ["userId"], ["ts", "transactionId"]
    placed = S.add_past(S.place(tx, key, F.unix_micros("ts")), order)
    one = F.lit(1).cast("bigint")
    counted = S.add_totals(placed, {
        "_fraud": F.coalesce(F.col("isFraud").cast("int"), F.lit(0)), "_paid": F.coalesce(F.col("amount").cast("double"), F.lit(0.0)),
        "_priced": F.col("amount").isNotNull().cast("bigint")})
    rows = S.add_totals(counted, {"_bought": one}, more=("merchantCategory",)).rows
    past = S.over_slices(key, F.asc_nulls_first("ts"), "transactionId").rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("ts").isNotNull()  # rows of totals have no time
    so_far = S.over_slices(key, F.asc("_own"), *order, more=["merchantCategory"]).rowsBetween(Window.unboundedPreceding, 0)
    seen = S.own(rows.withColumns({
        "elapsed": F.unix_micros("ts") - F.unix_micros(F.last("ts", ignorenulls=True).over(past)),
        "homeCountry": F.first(F.when(real, F.struct("country")), ignorenulls=True).over(past)["country"],
        "averageAmount": F.try_divide(F.sum("_paid").over(past), F.sum("_priced").over(past)),
        "priorFrauds": F.coalesce(F.sum("_fraud").over(past), F.lit(0)).cast("bigint"),
        "_m": F.sum("_bought").over(so_far)}).withColumn("_at", F.col("_slice"))).drop("_fraud", "_paid", "_priced", "_bought")
    named = F.col("merchantCategory").isNotNull()  # transactions without a category take no place
    within = Window.partitionBy(*key, "_at", "_m", "_named").orderBy(*order)
    placing = seen.withColumn("_named", named).withColumn("_place", F.row_number().over(within))
    if placed.busy is not None:
        meet = F.when(F.col("_place") <= categories, F.lit(-1).cast("bigint")).otherwise(F.col("_at"))
        across = Window.partitionBy(*key, "_meet", "_m", "_named").orderBy(*order)
        again = placing.withColumn("_meet", meet).withColumn("_over", F.row_number().over(across))
        placing = again.withColumn("_place", F.when(F.col("_meet") < 0, F.col("_over")).otherwise(F.col("_place")))
    usual = (F.col("_m") > 1) & (F.col("_place") <= categories)
    return placing.withColumn("usualCategory", F.when(F.col("elapsed").isNotNull() & F.col("_named"), usual)).select(
        *tx.columns, "averageAmount", "homeCountry", "usualCategory", "elapsed", "priorFrauds")


def risk_score(tx: DataFrame, profiles: DataFrame | None = None, risky_countries: list[str] | None = None,
               categories: int = 3) -> DataFrame:
    """Transactions with ``score`` (0 to 1) and ``decision``.

    What is usual for a user comes from the user's earlier transactions, or from a table of profiles where one is given. That
    join is the last shuffle, where adaptive execution can split a skewed user.
    """
    known = earlier_profiles(tx, categories)
    if profiles is not None:
        known = known.drop("averageAmount", "homeCountry", "usualCategory").join(profiles, "userId", "left").withColumn(
            "usualCategory", F.array_contains("preferredCategories", F.col("merchantCategory")))
    return scored(known, risky_countries).select(*tx.columns, "priorFrauds", "score", "decision")


def scored(known: DataFrame, risky_countries: list[str] | None = None) -> DataFrame:
    """Score and decision beside the columns of ``earlier_profiles``."""
    recent = micros("300 seconds")
    risky = F.col("country").isin(risky_countries or fixed.HIGH_RISK_COUNTRIES)
    method = F.col("paymentMethod") == "magnetic_stripe" if "paymentMethod" in known.columns else F.lit(False)
    weights = fixed.RISK_WEIGHTS
    score = (
        F.when(F.col("amount") > F.col("averageAmount") * weights["amount_factor"], weights["amount"]).otherwise(0.0)
        + F.when(F.hour("ts") < weights["night_until"], weights["night"]).otherwise(0.0)
        + F.when(risky, weights["risky_country"]).when(F.col("country") != F.col("homeCountry"), weights["other_country"]).otherwise(0.0)
        + F.when(~F.col("usualCategory"), weights["other_category"]).otherwise(0.0)
        + F.when(F.col("elapsed") < micros("60 seconds"), weights["within_minute"])
        .when(F.col("elapsed") < recent, weights["within_five_minutes"]).otherwise(0.0)
        + F.when(method, weights["magnetic_stripe"]).otherwise(0.0)
        + F.least(F.col("priorFrauds") * weights["per_prior_fraud"], F.lit(weights["most_prior_frauds"]))
    )
    score = F.round(F.least(score, F.lit(1.0)), 3)
    return (known.withColumn("score", score)
            .withColumn("decision", scoring.review_status(F.col("isFraud"), F.col("score"))))
