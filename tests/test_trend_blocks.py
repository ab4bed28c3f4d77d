"""A trend whose readings all lie in one block: split by density, equal to the plain slope."""

import random

import pytest
from builders import readings
from tidemark.operators import slicing as S
from tidemark.operators import windows
from pyspark.sql import functions as F


def plain(rows):
    """Least-squares slope of the values over their index in (time, id) order."""
    values = [v for _, _, v in sorted((t, i, v) for i, (t, v) in enumerate(rows))]
    n = len(values)
    sx, sxx = n * (n - 1) / 2, sum(i * i for i in range(n))
    sxy = sum(i * v for i, v in enumerate(values))
    return (n * sxy - sx * sum(values)) / (n * sxx - sx * sx)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_one_block(spark, hot, offset):
    rand = random.Random(1)
    rows = [(rand.random() * 100, offset + rand.random() * 10) for _ in range(600)]
    spark.conf.set(S.HOT_KEY_SETTING, "20")
    found = windows.sensor_trend(readings(spark, rows)).collect()
    whole = [r for r in found if r.dataPoints == 600]
    assert len(whole) == 5 and all(abs(r.trend - plain(rows)) < 1e-9 * max(offset, 1) for r in whole)


def test_the_block_is_spread(spark, hot):
    spark.conf.set(S.HOT_KEY_SETTING, "20")
    df = readings(spark, [(i / 10, float(i)) for i in range(900)])
    sizes = S.place(df, ["sensorType"], F.unix_micros("ts")).rows.groupBy("_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40 and sizes.count() >= 900 / 40
