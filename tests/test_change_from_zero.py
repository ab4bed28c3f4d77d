"""Changes from a previous value of zero: the queries and their SQL hold the same rows."""

import json
from datetime import timedelta

import duckdb
import pytest

import __spark_entry__ as contract
from builders import START
from check_oracle import compare

HOUR = 3600


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One sensor that rises from zero, stays there, rises from a negative zero and misses a value; another that never leaves it."""
    base = tmp_path_factory.mktemp("zero")
    values = [(1, 0.0), (1, 0.0), (1, 40.0), (1, -0.0), (1, -7.5), (1, None), (1, 3.0), (2, 0.0), (2, 0.0)]
    rows = [(i, START + timedelta(seconds=i * HOUR), user, "view", value, json.dumps({"k": 50})) for i, (user, value) in enumerate(values)]
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    naive = [(i, ts.replace(tzinfo=None), *rest) for i, ts, *rest in rows]
    spark.createDataFrame(naive, schema).coalesce(1).write.parquet(f"{base}/events.parquet")
    return str(base)


def connect_events(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["t3_rapid_change", "u2_anomaly_alerts"])
def test_change_from_zero_as_in_sql(spark, folder, name):
    con = connect_events(folder)
    text, _, good = compare(spark, con, name, folder)
    assert good, text
    found = contract.queries()[name](spark, folder)
    if name == "t3_rapid_change":
        assert sorted((r.previousValue, r.value, r.relativeChange) for r in found.collect()) == [
            (0.0, -7.5, float("inf")), (0.0, 40.0, float("inf")), (40.0, 0.0, 1.0)]
    else:
        assert sum("Infinity percent" in r.description for r in found.where("alertType = 'RAPID_CHANGE'").collect()) == 2
