"""A look-up by id or term reads the row groups that can hold it, and finds the same rows."""

from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.sources import documents

N = 200_000


def test_lookups_skip_row_groups(spark, tmp_path):
    docs = spark.range(N).select(
        F.sha2(F.col("id").cast("string"), 256).alias("doc_id"), F.concat(F.lit("user_"), F.pmod(F.xxhash64("id"), F.lit(N))).alias("userId"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("user-events").alias("index"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    was = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", str(128 * 1024))
    try:
        documents.upsert(docs.coalesce(2), str(tmp_path), 0, ["ts"], buckets=2, terms=("userId",))
    finally:
        hadoop.unset("parquet.block.size") if was is None else hadoop.set("parquet.block.size", was)
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == N

    def read(found):
        """Rows that the scan handed on, and rows found."""
        rows = found.collect()
        plan, scans = found._jdf.queryExecution().executedPlan(), []
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            metrics = leaf.metrics()
            if metrics.contains("numOutputRows"):
                scans.append(metrics.apply("numOutputRows").value())
        return sum(scans), rows

    some = docs.where("id = 777").first()
    seen, rows = read(search.all_of(stored, search.term("userId", some.userId)))
    assert len(rows) == docs.where(F.col("userId") == some.userId).count() and 0 < seen < N / 4
    seen, rows = read(search.all_of(stored, search.term("doc_id", some.doc_id)))
    assert [r.userId for r in rows] == [some.userId] and 0 < seen < N / 8
    seen, rows = read(search.all_of(stored, search.term("userId", "nobody")))
    assert rows == [] and seen < N / 8
