"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as contract
from tidemark.plans.catalog import QUERIES
from builders import SF
from tidemark.operators import keyed, search
from tidemark.sources import adapters

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas")


def plan(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.sub(r"#\d+L?", "", text)


@pytest.mark.parametrize("name", list(QUERIES))
def test_built_in_and_without_pairs(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert not [b for b in BAD if b in text], text


@pytest.mark.parametrize("name", ["t2_zscore", "t4_data_gaps", "t6_velocity_count", "t8_running_stats", "c1_velocity",
                                  "c2_structuring", "c3_country_change", "c4_card_testing", "c6_sequence",
                                  "m1_counter_rate", "m4_sustained", "u1_fraud_alerts"])
def test_one_scan_and_one_shuffle_without_hot_keys(spark, name):
    text = plan(contract.queries()[name](spark, SF), run=True)
    assert text.count("FileScan") == 1, text
    assert len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", text)) == 1, text


def test_hot_keys_stay_in_the_plan_and_spread(spark, hot):
    rows = adapters.sensors(spark, SF)
    text = plan(keyed.data_gaps(rows, "8 hours"), run=True)
    assert "hashpartitioning(sensorId, _slice" in text and "events.parquet" not in text
    from tidemark.operators import slicing
    from pyspark.sql import functions as F
    sizes = slicing.slice_rows(rows, ["sensorId"], F.unix_micros("ts")).groupBy("sensorId", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < rows.groupBy("sensorId").count().agg(F.max("count")).first()[0] / 4


def test_first_n_is_cut_in_the_map_tasks(spark):
    for df in (keyed.rate_limit(adapters.transactions(spark, SF)),
               keyed.dedupe(adapters.user_events(spark, SF), "userId", ["ts", "eventId"])):
        assert plan(df).count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    lo = adapters.F.lit("2024-01-10 00:00:00").cast("timestamp")
    events = adapters.table(spark, SF, "events")
    text = plan(search.all_of(events, search.range_("ts", gte=lo), search.term("user_id", 7)).select("ts"))
    assert "GreaterThanOrEqual(ts" in text and "EqualTo(user_id" in text
    assert "ReadSchema: struct<ts:timestamp,user_id:bigint>" in text



def test_a_burst_is_cut_finely(spark):
    """Half of a key's rows within a thousandth of its time."""
    from pyspark.sql import functions as F
    from tidemark.operators import slicing
    span = 30 * 86_400_000_000
    rows = spark.range(20000).select(F.lit("k").alias("k"), F.when(
        F.col("id") % 2 == 0, F.col("id") * (span // 20000)).otherwise(span // 3 + F.col("id") * (span // 1000 // 20000)).alias("p"))
    spark.conf.set(slicing.HOT_KEY_SETTING, "500")
    try:
        sizes = slicing.slice_rows(rows, ["k"], F.col("p")).groupBy("_slice").count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset(slicing.HOT_KEY_SETTING)
    assert sizes[0] <= 1500 and sizes[1] == 20000
