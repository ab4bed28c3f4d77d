"""Patterns of one user whose rows all lie within the time limit: worked by rank, spread over tasks, equal to the plain rule."""

import random

import pytest
from builders import TX, at
from pyspark.sql import functions as F
from tidemark.operators import alerts, patterns
from tidemark.operators.slicing import HOT_KEY_SETTING

ROWS = 2400


@pytest.fixture(scope="module")
def crowd(spark):
    rand = random.Random(9)
    rows = [(f"t{i:05d}", "u", at(rand.randrange(100)), float(rand.choice([20, 50, 500, 1500])), rand.choice(["completed"] * 3 + ["failed"] * 2),
             0.1, rand.choice(["US", "DE", None]), "retail", False) for i in range(ROWS)]
    kept = spark.createDataFrame(rows, TX).repartition(8).cache()
    kept.count()
    return kept


@pytest.fixture
def many_tasks(spark):
    changed = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false", HOT_KEY_SETTING: "100"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def walk(rows, stages, span):
    """(start id, end id, totals) of every match, by walking the rows."""
    rows = sorted(rows, key=lambda r: (r.ts, r.transactionId))
    out = []
    for i, first in enumerate(rows):
        at_row, totals = i, []
        for k, (holds, n) in enumerate(stages):
            if k == 0 and not holds(first):
                break
            mine = [j for j in range(i if k == 0 else at_row + 1, len(rows)) if holds(rows[j])][:n]
            if len(mine) < n:
                break
            at_row = mine[-1]
            totals.append(sum(rows[j].amount for j in mine))
        else:
            if (rows[at_row].ts - first.ts).total_seconds() < span:
                out.append((first.transactionId, rows[at_row].transactionId, totals))
    return sorted(out)


def done(r):
    return r.status == "completed"


CASES = {
    "velocity": (lambda tx: patterns.velocity(tx, n=5, within="2 minutes"), [(done, 5)], 120, ["all"]),
    "structuring": (lambda tx: patterns.structuring(tx, within="10 minutes"),
                    [(lambda r: done(r) and r.amount >= 1000, 1), (lambda r: done(r) and r.amount <= 100, 3)], 600, ["high", "small"]),
    "testing": (lambda tx: patterns.card_testing(tx, n=3, within="2 seconds"),
                [(lambda r: r.status == "failed", 3), (done, 1)], 2, ["failed", "success"]),
    "three": (lambda tx: patterns.Pattern.begin("a").where(F.col("amount") > 1000).times(2).followed_by("b").where(
        F.col("status") == "failed").followed_by("c").where(F.col("amount") < 100).times(4).within("20 seconds").select(tx, "userId", "transactionId"),
              [(lambda r: r.amount > 1000, 2), (lambda r: r.status == "failed", 1), (lambda r: r.amount < 100, 4)], 20, ["a", "b", "c"]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("limit", ["7", "100"])
def test_equal_to_walking(spark, crowd, many_tasks, name, limit):
    spark.conf.set(HOT_KEY_SETTING, limit)
    build, stages, span, names = CASES[name]
    part = crowd.where("transactionId < 't00400'")
    got = sorted((r.transactionId, r.endId, [r[f"{n}Total"] for n in names]) for r in build(part).collect())
    assert got == walk(part.collect(), stages, span) and got


@pytest.mark.parametrize("build", [CASES["structuring"][0], alerts.fraud_alerts], ids=["structuring", "fraud_alerts"])
def test_largest_task(spark, crowd, many_tasks, build):
    """No task after a shuffle reads an eighth of the user's rows."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    one, none = gateway.new_array(gateway.jvm.double, 1), gateway.new_array(gateway.jvm.double, 0)
    one[0] = 1.0
    # some hundred slices, so that chance puts few of them into one task
    spark.conf.set(HOT_KEY_SETTING, "25")

    def listed():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s for s in (found.apply(i) for i in range(found.size()))}

    known = listed()
    build(crowd).collect()
    most = 0
    for number, stage in listed().items():
        if number not in known and stage.shuffleReadRecords() >= ROWS / 4:
            quantiles = store.taskSummary(number, stage.attemptId(), one)
            most = max(most, quantiles.get().shuffleReadMetrics().readRecords().apply(0))
    assert 0 < most < ROWS / 8
