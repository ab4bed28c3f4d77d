"""Whole streaming jobs: messages in, named streams out. The caller chooses the sinks and starts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.functions.categories import topic_kind
from tidemark.operators import enrich as E
from tidemark.operators import metrics, routing, windows
from tidemark.sources import documents, parse
from tidemark.streaming import operators as O

Streams = dict[str, DataFrame]

# User events of the older form may call the user ``user_id`` and lack the region.
_OLD_USER_EVENT = ("userId STRING, user_id STRING, sessionId STRING, eventType STRING, timestamp STRING, page STRING, country STRING, "
                   "region STRING")


def _values(messages: DataFrame) -> DataFrame:
    return messages.select(F.concat_ws("-", "topic", "partition", "offset").alias("messageId"), "value")


def _of(messages: DataFrame, kind: str) -> DataFrame:
    return messages.where(topic_kind(F.col("topic")) == kind)


def user_events(messages: DataFrame, delay: str = "10 seconds") -> Streams:
    """Counts by user and type, page statistics, the overall rate, and sessions."""
    events = parse.parse_user_events(_values(messages)).withColumn("duration", F.col("additionalData")["duration"])
    timed = events.withWatermark("ts", delay)
    return {
        "event_aggregation": windows.count_by_user_type(timed), "page_aggregation": windows.page_stats(timed),
        "metrics": windows.event_rate(timed), "sessions": O.sessions(events, tiebreak="messageId", delay=delay)}


def transactions(messages: DataFrame, delay: str = "20 seconds", **limits) -> Streams:
    """Fraud alerts, and the risk score of every transaction."""
    tx = parse.parse_transactions(_values(messages))
    return {"fraud_alerts": O.fraud_alerts(tx, delay=delay, **limits), "risk_scores": O.risk_score(tx, delay=delay)}


def sensors(messages: DataFrame, delay: str = "10 seconds", **limits) -> Streams:
    """Alerts per sensor, deviations within a location, statistics and trends."""
    readings = parse.parse_sensors(_values(messages).withColumnRenamed("messageId", "id"))
    readings = readings.withColumn("readingId", F.xxhash64("id"))
    timed = readings.withWatermark("ts", delay)
    return {
        "anomaly_alerts": O.anomaly_alerts(readings, delay=delay, **limits),
        "deviations": windows.deviation_candidates(timed),
        "aggregates": routing.sensor_aggregates(timed)}


def stream_patterns(messages: DataFrame, delay: str = "20 seconds", high: float = 10_000, velocity_window: str = "300 seconds",
                    velocity_more_than: int = 5, per: str = "1 minute", per_user: int = 100,
                    width: str | None = "5 seconds") -> Streams:
    """Transactions with their user's latest event and their place's latest reading, rapid ones, statistics of the sensors, the two
    outputs by amount, user events in their current form, and transactions within the limit per user and minute.

    ``messages`` holds all three topics; each kind is read from the messages of its topic. Places are few, so what is joined by
    them is spread over tasks by slices of ``width``."""
    events = parse.parse_user_events(_values(_of(messages, "user_event"))).where(F.col("ts").isNotNull())
    tx = parse.parse_transactions(_values(_of(messages, "transaction_event")))
    readings = parse.parse_sensors(_values(_of(messages, "iot_sensor_event")))
    main, side = routing.split(tx, F.col("amount") > high, "HIGH_AMOUNT")
    raw = _values(_of(messages, "user_event")).select("messageId", F.from_json("value", _OLD_USER_EVENT).alias("_e")).select("messageId", "_e.*")
    current = parse.evolve(raw, {"userId": ["user_id"]}, {"region": "unknown"})
    return {
        "enriched_transactions": O.asof_join(tx, events, "userId", "event", "messageId", delay=delay),
        "rapid_transactions": O.velocity_count(tx, velocity_window, velocity_more_than, delay=delay),
        "located_transactions": O.asof_join(tx.where(F.col("location").isNotNull()), readings, "location", "reading", "messageId", width=width,
                                            delay=delay),
        "sensor_aggregates": routing.sensor_aggregates(readings.withColumn("readingId", F.xxhash64("messageId")).withWatermark("ts", delay)),
        "processed": main, "anomalies": side, "evolved_events": current,
        "limited_transactions": O.rate_limit(tx, per, per_user, delay=delay)}


def tuned_processing(messages: DataFrame, profiles: DataFrame, defaults: dict[str, object], delay: str = "10 seconds",
                     batch: int = 100, window: str = "1 minute", width: str | None = "5 seconds") -> Streams:
    """Running counts of each user's actions, transactions with their user's profile, batches of readings, and latency sketches.

    Types of sensors are few, so batches are put together from slices of ``width``. ``profiles`` has ``userId`` and columns of its own; ``defaults`` are those of a profile that is created on a miss."""
    events = parse.parse_user_events(_values(_of(messages, "user_event"))).where(F.col("ts").isNotNull())
    events = events.withColumn("eventId", F.xxhash64("messageId"))
    tx = parse.parse_transactions(_values(_of(messages, "transaction_event")))
    readings = parse.parse_sensors(_values(_of(messages, "iot_sensor_event"))).withColumn("readingId", F.xxhash64("messageId"))
    late = F.greatest(F.lit(0), F.unix_millis(F.current_timestamp()) - F.unix_millis("ts"))
    seen = [df.select(F.lit(kind).alias("kind"), "ts") for kind, df in (("user", events), ("transaction", tx), ("iot", readings))]
    every = seen[0].unionByName(seen[1]).unionByName(seen[2]).withColumn("latency", late).withWatermark("ts", delay)
    return {
        "user_statistics": O.running_stats(events, "eventType", live="1 hour", delay=delay),
        "profiled_transactions": O.profile_lookup(tx, profiles, "userId", defaults),
        "sensor_batches": O.count_batches(readings, batch, width=width, delay=delay),
        "latency_sketches": metrics.latency_sketches(every, "kind", "latency", "ts", window)}


def documents_of(messages: DataFrame, kind: str) -> DataFrame:
    """Enriched documents of their table's declared columns, with id and index, ready for the upsert.

    A message's place in its topic and its text make the id of a record without ids of its own; the text of a message
    that could not be read is kept in ``raw``.
    """
    parsers = {"user": (parse.parse_user_events, E.enrich_user, "user-events"),
               "transaction": (parse.parse_transactions, E.enrich_tx, "transaction-events"),
               "iot": (parse.parse_sensors, E.enrich_sensor, "iot-sensor-events")}
    read, enrich, source = parsers[kind]
    kept = _values(messages).withColumn("raw", F.col("value"))
    rows = parse.stamp(enrich(read(kept)), source)
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    known = documents.route_index(documents.doc_id(rows.withColumn("timestamp", text), record=("messageId", "raw")))
    unread = F.col("ts").isNull().alias("_unread")
    marked = known.select("*", unread).withColumn("raw", F.when(F.col("_unread"), F.col("raw")))
    return documents.conform(marked, source, more=("raw", "messageId", "processedAt", "eventSource", "index"))


def to_documents(docs: DataFrame, root: str, checkpoint: str, every: str = "1 minute",
                 rows_per_file: int = 5_000_000, terms: tuple[str, ...] = ()) -> DataStreamWriter:
    """A writer that upserts each batch; bulk sizes are the trigger interval and the rows per file. ``terms`` are the columns
    that are looked up by value."""
    write = documents.upsert_stream(root, ["ts"], rows_per_file=rows_per_file, terms=terms)
    return (docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every))


def start_all(streams: Streams, root: str, format: str = "parquet", **options: str) -> list[StreamingQuery]:
    """Starts every stream into its own folder with its own checkpoint."""
    return [df.writeStream.queryName(name).format(format).options(**options)
            .option("checkpointLocation", f"{root}/checkpoints/{name}").option("path", f"{root}/{name}")
            .outputMode("append").start()
            for name, df in streams.items()]
