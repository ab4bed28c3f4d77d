"""Gaps a moment short of half a digit: the alert's text rounds their minutes once, as the SQL does, whole, sliced and on a stream.
A severity half-way between two sixth digits is rounded as the SQL does."""

import json
from datetime import timedelta

import duckdb
import pytest

import __spark_entry__ as contract
from builders import START
from check_oracle import compare
from tidemark.sources import adapters
from tidemark.streaming import operators as O

#: 480.05 and 600.35 minutes, less or more by a microsecond.
GAPS = (28_803_000_000 - 1, 28_803_000_000, 36_021_000_000 - 1, 36_021_000_000 + 1)
SAID = ["silent for 480.0 min", "silent for 480.1 min", "silent for 600.3 min", "silent for 600.4 min"]


def times():
    at = [START]
    for gap in GAPS:
        at.append(at[-1] + timedelta(microseconds=gap))
    return at


def said(rows):
    return sorted(r.description for r in rows if r.alertType == "MISSING_DATA")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("gaps")
    # another sensor's reading, a day later, moves a stream's time on
    seen = [(1, ts) for ts in times()] + [(2, times()[-1] + timedelta(days=1))]
    seen = [(user, ts, 20.0) for user, ts in seen] + [(3, START, 51.2), (3, START + timedelta(hours=1), 77.84)]
    rows = [(i, ts.replace(tzinfo=None), user, "view", value, json.dumps({"k": 50})) for i, (user, ts, value) in enumerate(seen)]
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/events.parquet")
    return str(base)


def test_minutes_as_in_sql(spark, both, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    text, _, good = compare(spark, con, "u2_anomaly_alerts", folder)
    assert good, text
    found = contract.queries()["u2_anomaly_alerts"](spark, folder).collect()
    assert said(found) == SAID
    assert [r.severity for r in found if r.alertType == "RAPID_CHANGE"] == [0.520312]


def test_minutes_on_a_stream(spark, folder, tmp_path):
    events = spark.readStream.schema(adapters.SCHEMAS["events"]).parquet(f"{folder}/events.parquet")
    rows = adapters.sensors_of(events)
    found = O.anomaly_alerts(rows, timeout="8 hours", delay="1 second")
    query = (found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert said(spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()) == SAID
