"""Message topics as streaming tables. Without a broker the same functions read and write folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.categories import topic_kind

# Larger fetches for throughput; the batch limits bound a trigger's work.
TUNED = {
    "kafka.fetch.min.bytes": "65536", "kafka.fetch.max.wait.ms": "500", "kafka.max.poll.records": "1000",
    "kafka.receive.buffer.bytes": "262144", "kafka.send.buffer.bytes": "262144",
    "minOffsetsPerTrigger": "10000", "maxTriggerDelay": "2s", "maxOffsetsPerTrigger": "5000000",
}

MESSAGE = "topic STRING, partition INT, offset BIGINT, key STRING, value STRING"


def source_options(topics: list[str], starting: str = "latest", tuned: bool = False, **options: str) -> dict[str, str]:
    """Options of a broker source: the topics, where to start, the tuned settings if asked for, and then the caller's own."""
    return {"subscribe": ",".join(topics), "startingOffsets": starting, **(TUNED if tuned else {}), **options}


def read_topics(spark: SparkSession, topics: str | list[str], format: str = "kafka", path: str | None = None,
                starting: str = "latest", tuned: bool = False, **options: str) -> DataFrame:
    """Messages with topic, partition, offset, key and value as text. ``path`` is for file formats; ``tuned`` fetches in larger
    parts and bounds the work of a batch."""
    names = [topics] if isinstance(topics, str) else list(topics)
    reader = spark.readStream.format(format)
    if format != "kafka":
        return reader.schema(MESSAGE).options(**options).load(path).where(F.col("topic").isin(names))
    return (reader.options(**source_options(names, starting, tuned, **options)).load()
            .select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                    F.col("value").cast("string").alias("value")))


def read_topic(spark: SparkSession, topic: str, **options: str) -> DataFrame:
    """Message values of one topic."""
    return read_topics(spark, topic, **options).select("value")


def tagged(messages: DataFrame) -> DataFrame:
    """Messages of several topics with their kind; empty and unreadable ones are dropped."""
    doc = F.try_parse_json("value")
    return (messages.where(F.length("value") > 0).withColumn("kind", topic_kind(F.col("topic")))
            .where(doc.isNotNull()))


def envelope(messages: DataFrame, timestamp: Column) -> DataFrame:
    """The message forwarded to clients: type, data, timestamp, topic, partition, offset."""
    return messages.select(
        F.col("kind").alias("type"), F.col("value").alias("data"), F.unix_millis(timestamp).alias("timestamp"),
        "topic", "partition", "offset")


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON text; ``key`` keeps the rows of a key in one partition and so in order."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_topic(df: DataFrame, topic: str, checkpoint: str, key: str | None = None, format: str = "kafka",
                **options: str) -> DataStreamWriter:
    """A writer of rows to a topic, to be started by the caller."""
    out = as_messages(df, key)
    writer = out.writeStream.format(format).option("checkpointLocation", checkpoint).options(**options)
    return writer.option("topic", topic) if format == "kafka" else writer


def write_console(df: DataFrame, mode: str = "append", rows: int = 20) -> DataStreamWriter:
    return df.writeStream.format("console").outputMode(mode).option("numRows", rows).option("truncate", "false")
