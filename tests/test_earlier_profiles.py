"""What is known of a user before each transaction, against a plain walk over the earlier rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from builders import TX, at
from tidemark.operators import enrich


def plain(rows, categories):
    """Per transaction: mean, home, usual, elapsed, frauds of the user's rows before it."""
    out = {}
    for user in {r[1] for r in rows}:
        past = []
        for r in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            paid = [p[3] for p in past if p[3] is not None]
            many = Counter(p[7] for p in past if p[7] is not None)
            ahead = sum(n > many[r[7]] for n in many.values())
            out[r[0]] = (sum(paid) / len(paid) if paid else None, past[0][6] if past else None,
                         (many[r[7]] > 0 and ahead < categories) if past and r[7] is not None else None,
                         int((r[2] - past[-1][2]).total_seconds() * 1_000_000) if past else None, sum(bool(p[8]) for p in past))
            past.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("categories", [1, 3])
def test_earlier_rows_only(spark, both, seed, categories):
    r = random.Random(seed)
    names = ["food", "travel", "fuel", "toys", "books", None]
    rows = [(f"t{i:03d}", r.choices(["a", "b", "c", None], [8, 2, 1, 1])[0], at(r.randrange(0, 300)), r.choice([5.0, 50.5, None]), "completed", 0.1,
             r.choice(["US", "DE", None]), r.choices(names, [5, 4, 3, 2, 1, 1])[0], r.choice([True, False, None])) for i in range(150)]
    got = enrich.earlier_profiles(spark.createDataFrame(rows, TX), categories).collect()
    want = plain(rows, categories)
    assert len(got) == len(rows)
    for row in got:
        mean, home, usual, elapsed, frauds = want[row.transactionId]
        assert row.averageAmount == (None if mean is None else pytest.approx(mean))
        assert (row.homeCountry, row.usualCategory, row.elapsed, row.priorFrauds) == (home, usual, elapsed, frauds), row


def test_later_rows_tell_nothing(spark, both):
    """A score does not change when the user goes on buying."""
    rows = [(f"t{i:03d}", "u", at(40 * i), 10.0 + 90 * (i % 5 == 4), "completed", 0.1, ["US", "DE"][i % 7 == 6],
             ["food", "fuel", "toys", "books"][i * i % 4], i % 6 == 5) for i in range(40)]
    full = enrich.risk_score(spark.createDataFrame(rows, TX)).where(F.col("transactionId") < "t020")
    half = enrich.risk_score(spark.createDataFrame(rows[:20], TX))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, half.collect()))


def test_own_columns_stay(spark):
    """A table of profiles still takes the place of the history."""
    rows = [(f"t{i}", "u", at(400 * i), 10.0, "completed", 0.1, "US", c, False) for i, c in enumerate("aabbc")]
    tx = spark.createDataFrame(rows, TX)
    got = enrich.risk_score(tx, enrich.user_profiles(tx, categories=2)).orderBy("transactionId")
    assert [c for c in got.columns if c not in tx.columns] == ["priorFrauds", "score", "decision"]
    assert [row.score > 0.25 for row in got.collect()] == [False, False, False, False, True]
