"""Helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Python's str.split() takes as white space, as a class for Spark's patterns.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``. Where it is unset the session must be local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 200) -> DataFrame:
    """Smallest reachable vertex of every vertex of an undirected graph: columns ``v``, ``component``.

    Rounds of two steps: every vertex takes the smallest label around it, then labels follow their own labels (pointer
    jumping), so paths shorten exponentially. A vertex with very many edges is only ever aggregated (smallest label,
    combined in the map tasks) or joined on (adaptive execution splits it); no neighbour list is gathered. Each round is
    written to the shared folder. Ends when no label changes.
    """
    both = (edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
            .unionAll(edges.select(F.col(b).alias("v"), F.col(a).alias("u"))).where("v <> u").distinct())
    both = stored(both)
    labels = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("component")))
    for _ in range(limit):
        near = (both.join(labels.select(F.col("v").alias("u"), F.col("component").alias("near")), "u")
                .groupBy("v").agg(F.min("near").alias("near")))
        lower = labels.join(near, "v").select("v", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("v").alias("component"), F.col("component").alias("root"))
        fresh = stored(lower.join(jump, "component", "left").select(
            "v", F.least("component", F.coalesce("root", "component")).alias("component"), "was"))
        labels = fresh.select("v", "component")
        if fresh.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {limit} rounds")


def unpacked(data: bytes, press=zstandard.ZstdDecompressor()) -> str:
    return press.decompress(data).decode()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
