"""Last-n moments against exact arithmetic: large offsets, equal values, missing values, any n, whole and sliced keys."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from builders import readings
from tidemark.operators import keyed
from tidemark.operators import slicing as S


def exact(values, n):
    """Per row the mean and the deviation of the last n values, in rationals."""
    out = []
    for i in range(len(values)):
        window = [Fraction(v) for v in values[max(0, i - n + 1):i + 1] if v is not None]
        mean = sum(window) / len(window) if window else None
        variance = sum((v - mean) ** 2 for v in window) / len(window) if window else None
        out.append((min(i + 1, n), mean, variance))
    return out


def last_rows(table, n):
    placed = S.place(table, ["sensorId"], F.unix_micros("ts"))
    return S.last_rows(placed, ["ts", "readingId"], "value", n)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_moments(spark, both, n):
    r = random.Random(n)
    series = {"far": [1e9 + r.random() for _ in range(60)], "drift": [1000.0 * i + r.random() for i in range(60)],
              "near": [r.gauss(0, 1) for _ in range(23)], "flat": [0.1] * 20, "few": [3.0, 4.0]}
    rows = [(r.randrange(0, 400), v, s) for s, values in series.items() for v in values]
    rows.sort(key=lambda x: x[0])
    table = readings(spark, rows)
    by_sensor = {}
    for i, (_, v, s) in enumerate(rows):
        by_sensor.setdefault(s, []).append((i, v))
    got = {row.readingId: row for row in last_rows(table, n).collect()}
    assert len(got) == len(rows)
    for sensor, own in by_sensor.items():
        previous = None
        for (i, v), (many, mean, variance) in zip(own, exact([v for _, v in own], n)):
            row = got[i]
            assert row._n == many
            assert abs(Fraction(row._mean) - mean) <= Fraction(max(abs(v), abs(float(mean)))) * Fraction(1, 10 ** 15)
            # The tolerance is relative to the deviation itself, however far from zero the values lie.
            assert row._std == pytest.approx(math.sqrt(variance), rel=1e-9)
            assert row._off == pytest.approx(abs(float(Fraction(v) - mean)), rel=1e-9, abs=1e-9 * row._std)
            assert (row._prev.value if row._prev else None) == previous
            if sensor == "flat":
                assert row._std == 0.0
            previous = v


def test_missing_values(spark, both):
    r = random.Random(4)
    values = [None if r.random() < 0.4 else r.random() for _ in range(40)]
    table = readings(spark, [(i, 0.0 if v is None else v) for i, v in enumerate(values)])
    missing = [i for i, v in enumerate(values) if v is None]
    table = table.withColumn("value", F.when(~F.col("readingId").isin(missing), F.col("value")))
    got = [tuple(row) for row in last_rows(table, 5).orderBy("ts").select("_n", "_mean", "_std").collect()]
    for (n, mean, std), (many, want, variance) in zip(got, exact(values, 5)):
        assert n == many
        if want is None:
            assert mean is None and std is None
        else:
            assert mean == pytest.approx(float(want), rel=1e-12)
            assert std == pytest.approx(math.sqrt(variance), rel=1e-9, abs=1e-12)


def test_no_key_takes_rows_of_another(spark, hot):
    """Nulls are a key of their own; no sensor's window reaches into another's."""
    table = readings(spark, [(i, float(i % 2) + 100 * (i % 3), ["a", "b", None][i % 3]) for i in range(60)])
    got = last_rows(table, 4).where("_n = 4").groupBy("sensorId").agg(F.min("_mean").alias("lo"), F.max("_mean").alias("hi"), F.count("*").alias("n"))
    for row in got.collect():
        base = {"a": 0, "b": 100, None: 200}[row.sensorId]
        assert base <= row.lo <= row.hi <= base + 1 and row.n == 17


def test_alerts_of_flat_sensors(spark, both):
    """A sensor that never moves has no deviation to be measured by, and one jump is an alert."""
    flat = readings(spark, [(i, 20.1) for i in range(40)])
    assert keyed.zscore_alerts(flat, n=12).count() == 0
    jump = readings(spark, [(i, 20.1 if i != 35 else 30.0) for i in range(40)])
    found = keyed.zscore_alerts(jump, n=12).collect()
    assert [(row.readingId, row.readings) for row in found] == [(35, 12)]
    assert found[0].zScore == pytest.approx(math.sqrt(11))
