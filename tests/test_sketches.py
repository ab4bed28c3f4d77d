"""Latency sketches: merged over windows against exact ranks, on a table and on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from builders import at
from tidemark.operators import metrics

QUANTILES = (0.5, 0.95, 0.99)


def latencies(seed, n):
    r = random.Random(seed)
    return [("slow" if r.random() < 0.2 else "fast", at(r.randrange(0, 7200)), r.lognormvariate(3, 2)) for _ in range(n)]


def off(values, estimate, q):
    """How far the ranks that the estimate may have are from q."""
    below, upto = sum(v < estimate for v in values) / len(values), sum(v <= estimate for v in values) / len(values)
    return max(below - q, q - upto, 0.0)


@pytest.mark.parametrize("k", [100, 800])
def test_merged_over_windows(spark, k):
    rows = latencies(k, 30_000)
    table = spark.createDataFrame(rows, "kind STRING, ts TIMESTAMP, latency DOUBLE").repartition(8)
    sketches = metrics.latency_sketches(table, "kind", "latency", "ts", "10 minutes", k)
    assert sketches.count() == 24
    for row in metrics.merged_latency(sketches, ["kind"], QUANTILES, k).collect():
        values = [v for kind, _, v in rows if kind == row.kind]
        assert row.processed == len(values)
        for q in QUANTILES:
            assert off(values, row[f"p{round(q * 100)}"], q) <= 3 * metrics.rank_error(k)


def test_the_size_does_not_grow(spark):
    """Ten times the values, nearly the same sketch."""
    def size(n):
        table = spark.range(n).select(F.lit("a").alias("kind"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.rand(1).alias("latency"))
        return metrics.latency_sketches(table, "kind", "latency", "ts", "1 hour").select(F.octet_length("sketch")).first()[0]

    assert size(1_000_000) < 1.5 * size(100_000)


def test_missing_latencies(spark):
    table = spark.createDataFrame([("a", at(0), None), ("b", at(1), 4.0), ("b", at(700), None), ("b", at(2), 4.0)],
                                  "kind STRING, ts TIMESTAMP, latency DOUBLE")
    got = metrics.merged_latency(metrics.latency_sketches(table, "kind", "latency", "ts", "10 minutes"), ["kind"]).collect()
    assert [tuple(row) for row in got] == [("b", 2, 4.0, 4.0, 4.0)]


def test_on_a_stream(spark, tmp_path):
    rows = latencies(7, 5000)
    table = spark.createDataFrame([*rows, ("end", at(100_000), 1.0)], "kind STRING, ts TIMESTAMP, latency DOUBLE")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "2 hours")
    sketches = metrics.latency_sketches(live, "kind", "latency", "ts", "10 minutes")
    query = (sketches.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.agg(F.sum("processed")).first()[0] == len(rows)
    for row in metrics.merged_latency(stored, ["kind"]).collect():
        values = [v for kind, _, v in rows if kind == row.kind]
        assert all(off(values, row[f"p{round(q * 100)}"], q) <= 3 * metrics.rank_error(800) for q in QUANTILES)
