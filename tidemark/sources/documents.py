"""Keyed document tables: ids, routing, and an upsert that can be repeated.

A document table is a folder of batches. A batch is known by its writer, its table (``index``) and its number: it is
written whole and replaced whole when it is repeated, so a retried batch changes nothing, and no writer touches what
another one wrote. A stream's writer is its query id, which lives in its checkpoint: a stream with a new checkpoint is
a new writer and counts its batches from 0 without harm. Within a batch rows lie in ``buckets`` files by a hash of the id,
so a look-up by id reads one bucket. Reading takes the latest row of each id over all batches; ``fold`` writes what is
read as the base of a new folder, under a writer of its own, which every later batch outranks at equal order.

Within a file rows are sorted by id, and ids and the columns named as ``terms`` have Bloom filters, so a filter that names
one of their values skips the row groups that do not hold it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fixed_values import INDEXES
from tidemark.schemas import declared

BUCKETS = 16
BASE = "base"


def _clean(c: str) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "_")


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def doc_id(df: DataFrame, time: str = "timestamp", record: tuple[str, ...] = ()) -> DataFrame:
    """Transaction id, else sensor and time, else user and time, else a digest of the row.

    ``record``: columns that tell a record from all others and stay the same when it is delivered again (its place in
    the topic, its text). The digest is made of them where given, so that unreadable records keep ids of their own.
    """
    ids = [F.col("transactionId")] if _has(df, "transactionId") else []
    for owner in ("sensorId", "userId"):
        if _has(df, owner, time):
            ids.append(F.when(F.col(owner).isNotNull() & F.col(time).isNotNull(),
                              F.concat_ws("_", owner, _clean(time))))
    return df.withColumn("doc_id", F.coalesce(*ids, F.sha2(F.to_json(F.struct(*(record or df.columns))), 256)))


def route_index(df: DataFrame) -> DataFrame:
    """The table a record belongs to, by the ids it carries."""
    index = F.lit("user-events")
    for name in reversed(list(INDEXES)):
        if name in df.columns:
            index = F.when(F.col(name).isNotNull(), INDEXES[name]).otherwise(index)
    return df.withColumn("index", index)


def compact_latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; map tasks already keep one row per key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def retain(df: DataFrame, ts: str, max_age: str) -> DataFrame:
    """Rows no older than ``max_age`` before the newest one."""
    newest = df.groupBy().agg(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest - F.expr(f"INTERVAL {max_age}"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _for_lookups(df: DataFrame, key: str, terms: tuple[str, ...], rows_per_file: int) -> DataFrameWriter:
    """A writer of documents in folders by table and bucket; a filter is as large as its row group's values ask for."""
    writer = df.sortWithinPartitions("index", "bucket", key).write.option("maxRecordsPerFile", rows_per_file)
    for c in (key, *terms):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("index", "bucket")


def upsert(df: DataFrame, root: str, batch: int, order: list[str], key: str = "doc_id", writer: str = "batch",
           buckets: int = BUCKETS, rows_per_file: int = 5_000_000, terms: tuple[str, ...] = ()) -> None:
    """Writes one batch. Repeating it with the same writer and number replaces what it wrote before, and nothing else."""
    if not re.fullmatch(r"[\w.-]+", writer):
        raise ValueError(f"a writer's name is made of letters, digits, '.', '_' and '-': {writer!r}")
    latest = compact_latest(df, ["index", key], order).withColumn("bucket", _bucket(F.col(key), buckets))
    _for_lookups(latest, key, terms, rows_per_file).mode("overwrite").parquet(f"{root}/writer={writer}/batch={batch}")


def stream_writer(df: DataFrame) -> str:
    """The id of the streaming query that hands out this batch; a new checkpoint has a new one."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"


def upsert_stream(root: str, order: list[str], key: str = "doc_id", buckets: int = BUCKETS,
                  rows_per_file: int = 5_000_000, terms: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """The same as a ``foreachBatch`` function."""
    return lambda df, batch: upsert(df, root, batch, order, key, stream_writer(df), buckets, rows_per_file, terms)


def read_documents(spark: SparkSession, root: str, schema: T.StructType, order: list[str], key: str = "doc_id",
                   index: str | None = None, ident: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The current documents; between equal ``order`` values the later batch wins, and any batch outranks a base.

    ``index`` and ``ident`` (one id) read only the folders that can hold them.
    """
    placed = [T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType()),
              T.StructField("index", T.StringType()), T.StructField("bucket", T.IntegerType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *placed])).option("basePath", root).parquet(root)
    if index is not None:
        rows = rows.where(F.col("index") == index)
    if ident is not None:
        rows = rows.where((F.col("bucket") == _bucket(F.lit(ident), buckets)) & (F.col(key) == ident))
    rows = rows.withColumn("_later", F.col("writer") != BASE)
    return compact_latest(rows, ["index", key], [*order, "_later", "batch", "writer"]).drop("_later", "batch", "bucket", "writer")


def fold(spark: SparkSession, root: str, target: str, schema: T.StructType, order: list[str], key: str = "doc_id",
         buckets: int = BUCKETS, rows_per_file: int = 5_000_000, terms: tuple[str, ...] = ()) -> None:
    """Writes the current documents as the base of a new folder."""
    if root.rstrip("/") == target.rstrip("/"):
        raise ValueError("fold into a new folder")
    now = read_documents(spark, root, schema, order, key).withColumn("bucket", _bucket(F.col(key), buckets))
    _for_lookups(now, key, terms, rows_per_file).mode("errorifexists").parquet(f"{target}/writer={BASE}/batch=0")


def bulk_load(df: DataFrame, path: str) -> DataFrame:
    """Writes a table; one row of how many rows the source has (``sent``) and the written table holds (``stored``)."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path).groupBy().agg(F.count(F.lit(1))).scalar()
    return df.groupBy().agg(F.count(F.lit(1)).alias("sent")).select("sent", stored.alias("stored"))


def conform(df: DataFrame, name: str, registry: dict[str, str] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The columns declared for a table name, in order and type; absent ones are null. Then ``more`` as they are."""
    schema = declared(name, registry)
    if schema is None:
        return df
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
                       for f in schema.fields], *more)
