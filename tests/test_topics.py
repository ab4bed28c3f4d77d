"""Sources and sinks of messages, and outputs that are handed out once."""

import pytest
from builders import transactions
from pyspark.sql import functions as F
from tidemark.operators import routing
from tidemark.sources import topics


def test_tuned_options():
    plain = topics.source_options(["a", "b"])
    tuned = topics.source_options(["a"], "earliest", tuned=True, maxOffsetsPerTrigger="7")
    assert plain == {"subscribe": "a,b", "startingOffsets": "latest"}
    assert tuned["startingOffsets"] == "earliest" and tuned["kafka.fetch.min.bytes"] == "65536"
    assert tuned["kafka.max.poll.records"] == "1000" and tuned["maxOffsetsPerTrigger"] == "7"


def test_one_topic_of_several(spark, tmp_path):
    rows = [("a", 0, 1, "k", "1"), ("b", 0, 1, "k", "2"), ("a", 0, 2, None, None)]
    spark.createDataFrame(rows, topics.MESSAGE).write.parquet(str(tmp_path / "in"))
    stream = topics.read_topic(spark, "a", format="parquet", path=str(tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("one_topic").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.value or "") for r in spark.table("one_topic").collect()) == ["", "1"]


def test_console(spark, tmp_path):
    spark.createDataFrame([("shown in the console",)], "value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    query = topics.write_console(stream).trigger(availableNow=True).start()
    query.awaitTermination()
    # the JVM writes to the output it was started with, which no test can read
    assert query.exception() is None and query.lastProgress is not None
    assert "Console" in query.lastProgress.sink.description and query.lastProgress.numInputRows == 1


@pytest.mark.parametrize("fails", ["main", "side"])
def test_outputs_once_each(spark, tmp_path, fails):
    """A writer fails once; the batch is run again, and no output gets rows twice."""
    calls = {"main": 0, "side": 0}

    def writer(name):
        def write(df, number):
            calls[name] += 1
            if name == fails and calls[name] == 1:
                raise OSError("no room")
            df.write.mode("append").parquet(str(tmp_path / name))
        return write

    write = routing.split_stream(F.col("amount") > 500, "HIGH", writer("main"), writer("side"), str(tmp_path / "ledger"))
    batch = transactions(spark, [(1, 100, "completed"), (2, 900, "completed"), (3, 50, "failed")])
    with pytest.raises(OSError):
        write(batch, 0)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "main")).count() == 2 and spark.read.parquet(str(tmp_path / "side")).count() == 1
    assert calls == ({"main": 2, "side": 1} if fails == "main" else {"main": 1, "side": 2})
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "main")).count() == 4
