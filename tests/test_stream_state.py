"""What a stream keeps per key: waiting rows by time bucket, and counts per action that end after their time."""

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from builders import EVENT, at
from tidemark.operators import keyed
from tidemark.streaming import operators as O
from tidemark.streaming.ordered import InOrder, Rule


PLACE = T.StructType([T.StructField("_p", T.LongType()), T.StructField("_id", T.LongType())])


class Shelf:
    """A state of one key, held in a dict; counts the rows that are read."""

    def __init__(self):
        self.have, self.read = {}, 0

    def exists(self):
        return None in self.have

    def get(self):
        return self.have[None]

    def update(self, value):
        self.have[None] = value

    def clear(self):
        self.have.clear()

    def getValue(self, key):
        self.read += len(self.have[key][0])
        return self.have[key]

    def updateValue(self, key, value):
        self.have[key] = value

    def removeKey(self, key):
        del self.have[key]


class Handle:
    def __init__(self):
        self.shelves, self.timers, self.now = {}, set(), 0

    def getMapState(self, name, *_):
        return self.shelves.setdefault(name, Shelf())

    getValueState = getMapState

    def registerTimer(self, when):
        assert when not in self.timers
        self.timers.add(when)

    def deleteTimer(self, when):
        self.timers.remove(when)

    def getCurrentWatermarkInMs(self):
        return self.now


class Echo(Rule):
    memory = "n BIGINT"

    def step(self, memory, row):
        return ((memory[0] if memory else 0) + 1,), [row]


def waiting(width):
    handle = Handle()
    processor = InOrder(Echo(), PLACE, ["key", "_p", "_id"], None, width)
    processor.init(handle)
    return handle, processor, handle.shelves["waiting"]


def due(handle, processor, now):
    handle.now = now
    handle.timers = {t for t in handle.timers if t > now}
    return [tuple(r)[1:] for r in processor.handleExpiredTimer(("k",), handle, None)]


def test_a_timer_reads_the_buckets_that_are_due():
    handle, processor, shelf = waiting(1_000_000)
    rows = [Row(_p=i * 1000, _id=i) for i in range(8000)]
    for start in range(7, -1, -1):  # eight triggers, rows from everywhere in each
        list(processor.handleInputRows(("k",), iter(rows[start::8]), handle))
    assert shelf.read == 0 and handle.timers == {0}
    assert due(handle, processor, 499) == [(i * 1000, i) for i in range(500)]
    assert shelf.read == 1000 and handle.timers == {500}
    assert due(handle, processor, 2499) == [(i * 1000, i) for i in range(500, 2500)]
    assert shelf.read == 1000 + 500 + 2000 and handle.timers == {2500}
    assert len(due(handle, processor, 10_000)) == 5500
    assert not shelf.have and not handle.timers


def test_rows_before_the_epoch_and_of_one_instant():
    handle, processor, shelf = waiting(1_000_000)
    for ident in (3, None, 1):
        list(processor.handleInputRows(("k",), iter([Row(_p=-5_000_500, _id=ident)]), handle))
    assert handle.timers == {-5000}
    assert [i for _, i in due(handle, processor, -5000)] == [None, 1, 3]
    assert not shelf.have and not handle.timers


def counted(spark, folder, rows, **options):
    """The stream's counts by event; each tuple of rows (seconds, action) is a batch, and a far one ends it."""
    ident = 0
    for batch in (*rows, [(10_000_000, "end")]):
        full = [(ident + i, "u", action, at(second), "s", None, "US") for i, (second, action) in enumerate(batch)]
        ident += len(full)
        spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (O.running_stats(live, "eventType", delay="10 seconds", **options).writeStream.format("parquet")
             .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").where("action <> 'end'").orderBy("ts", "eventId")
    return [(r.action, r.eventTypeCount, r.lastProcessingInterval) for r in out.collect()]


BATCHES = [[(0, "a"), (5, "b"), (7, "a")], [(3000, "a"), (3500, "b")], [(7000, "a"), (7001, "b"), (7002, "a")]]


def test_counts_end_after_their_time(spark, tmp_path):
    got = counted(spark, str(tmp_path), BATCHES, live="1 hour", forget=None)
    assert [(a, n) for a, n, _ in got] == [
        ("a", 1), ("b", 1), ("a", 2), ("a", 3), ("b", 2), ("a", 1), ("b", 3), ("a", 2)]


def test_counts_that_stay_are_those_of_the_table(spark, tmp_path):
    got = counted(spark, str(tmp_path), BATCHES, forget=None)
    full = [(i, "u", action, at(second), "s", None, "US") for i, (second, action) in enumerate(sum(BATCHES, []))]
    table = keyed.running_stats(spark.createDataFrame(full, EVENT), "eventType").orderBy("ts", F.col("eventId"))
    assert got == [(r.eventType, r.eventTypeCount, r.lastProcessingInterval) for r in table.collect()]


def test_an_idle_user_is_forgotten(spark, tmp_path):
    batches = [[(0, "a"), (5, "a")], [(50_000, "b")], [(200_000, "a"), (200_001, "b")]]
    got = counted(spark, str(tmp_path), batches, forget="24 hours")
    assert [(a, n) for a, n, _ in got] == [("a", 1), ("a", 2), ("b", 1), ("a", 1), ("b", 1)]
    assert got[3][2] == 0
