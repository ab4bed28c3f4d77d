"""Keys spread over tasks by time slice: the rows of the table, whatever the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from builders import READING, TX, at
from tidemark.operators import joins, keyed
from tidemark.streaming import operators as O

FAR = 10_000_000


@pytest.fixture
def feed(spark, tmp_path):
    """A stream of rows, up to 50 seconds out of order over five files, and a last row far ahead; and their table."""

    def made(name, rows, schema, far):
        r = random.Random(5)
        rows = sorted(rows, key=lambda row: (row[2] if schema == TX else row[4]).timestamp() + r.random() * 50)
        for i in range(5):
            spark.createDataFrame(rows[i * len(rows) // 5:(i + 1) * len(rows) // 5], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([far], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return (spark.createDataFrame(rows, schema),
                spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))

    return made


def readings(n, kind="temperature"):
    r = random.Random(n)
    rows = [(i, f"s{i % 7}", kind, "hall", at(r.randrange(600)), float(i % 90), 50, False) for i in range(n)]
    return rows, (-1, "far", "far", "far", at(FAR), 0.0, 50, False)


def drain(df, tmp_path, spark, name):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_batches_of_one_type(spark, feed, tmp_path):
    table, stream = feed("r", *_with(readings(1000), READING))
    spread = O.count_batches(stream, 30, width="10 seconds", delay="1 minute").withColumn("task", F.spark_partition_id())
    got = drain(spread, tmp_path, spark, "spread_batches").where("sensorType <> 'far'")
    summaries, inside = keyed.count_batches(table, 30, partial=False)
    assert rows(got.where("kind = 'summary'"), "batch", "batchSize", "batchAverage") == rows(summaries, "batch", "batchSize", "averageValue") != []
    assert rows(got.where("kind = 'row'"), "readingId", "batch", "batchAverage") == rows(inside, "readingId", "batch", "batchAverage") != []
    assert got.select("task").distinct().count() > 2


def _with(made, schema):
    return made[0], schema, made[1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_latest_reading_of_one_place(spark, feed, tmp_path, how):
    r = random.Random(3)
    pays = [(f"t{i:03d}", "hall" if i % 5 else None, at(r.randrange(600)), float(i), "completed", 0.1, "US", "retail", False) for i in range(400)]
    far = ("far", "far", at(FAR), 0.0, "completed", 0.1, "US", "retail", False)
    left, left_stream = feed("l", pays, TX, far)
    right, right_stream = feed("r", *_with(readings(40), READING))
    options = {"tolerance": "45 seconds", "how": how}
    live = O.asof_join(left_stream.withColumnRenamed("userId", "location"), right_stream.where("sensorId <> 's3'"), "location", "s",
                       "readingId", width="10 seconds", delay="1 minute", **options).withColumn("task", F.spark_partition_id())
    want = joins.asof_join(left.withColumnRenamed("userId", "location"), right.where("sensorId <> 's3'"), "location", "s", "readingId", **options)
    got = drain(live, tmp_path, spark, f"spread_{how}").where("transactionId <> 'far'")
    names = ("transactionId", "location", "ts", "s.readingId", "s.ts", "s.value")
    assert rows(got, *names) == rows(want, *names) != []
    assert got.where("s IS NOT NULL").select("task").distinct().count() > 2


def test_batches_of_spread_keys_have_no_timeout(spark, tmp_path):
    live = spark.readStream.schema(READING).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        O.count_batches(live, 10, timeout="1 minute", width="10 seconds")
