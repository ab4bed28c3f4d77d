"""Profiles on a stream: the table's rows, profiles created on a miss, and both again after a restart."""

from pyspark.sql import functions as F

from builders import at
from tidemark.operators import joins
from tidemark.streaming import operators as O

ORDER = "orderId STRING, userId STRING, ts TIMESTAMP"
PROFILE = "userId STRING, tier STRING, since TIMESTAMP"
DEFAULTS = {"tier": "premium"}


def run(spark, folder, profiles):
    live = spark.readStream.schema(ORDER).parquet(f"{folder}/in")
    query = (O.profile_lookup(live, profiles, "userId", DEFAULTS).writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def put(spark, folder, rows):
    orders = spark.createDataFrame([(f"o{i}", user, at(i)) for i, user in rows], ORDER)
    orders.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return orders


def test_profiles_of_a_stream(spark, tmp_path):
    folder = str(tmp_path)
    profiles = spark.createDataFrame([("a", "gold", at(5)), ("b", None, at(6)), ("z", "basic", None)], PROFILE)
    first = put(spark, folder, [(0, "a"), (1, "b"), (2, "new"), (3, "a"), (4, "new")])
    got = run(spark, folder, profiles)
    want = joins.lookup(first, profiles, "userId", DEFAULTS)
    columns = ["orderId", "userId", "ts", "tier", "since"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    created = [row.userId for row in got.where("NOT profileKnown").collect()]
    assert created == ["new"]

    # After a restart the created profile is known, and the table is not read again: what it says now changes nothing.
    put(spark, folder, [(10, "new"), (11, "a"), (12, "later")])
    changed = profiles.withColumn("tier", F.lit("changed"))
    again = {row.orderId: row for row in run(spark, folder, changed).where("orderId >= 'o10' AND length(orderId) = 3").collect()}
    assert {k: (row.tier, row.profileKnown) for k, row in again.items()} == {
        "o10": ("premium", True), "o11": ("gold", True), "o12": ("premium", False)}


def test_no_profiles_at_all(spark, tmp_path):
    put(spark, str(tmp_path), [(0, "a"), (1, "a")])
    got = run(spark, str(tmp_path), spark.createDataFrame([], PROFILE)).collect()
    assert [row.tier for row in got] == ["premium"] * 2 and sum(row.profileKnown for row in got) == 1
