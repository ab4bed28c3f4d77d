"""Patterns, joins and runs against brute force over random rows, with whole and with sliced keys."""

import random

import pytest
from pyspark.sql import functions as F

from builders import events, readings, transactions
from tidemark.operators import joins, keyed, patterns


def rows_of(seed, n=120, users=("a", "b")):
    """Many rows of few users, with equal times."""
    r = random.Random(seed)
    return [(r.randrange(0, 400), r.choice([5, 50, 500, 1500]), r.choice(["completed", "failed"]),
             r.choice(["US", "DE"]), r.choices(users, [4, 1])[0]) for _ in range(n)]


def match(rows, stages, within):
    """Every row that meets the first stage takes the next rows that meet each stage in turn."""
    found = []
    ordered = sorted(((s, f"t{i:03d}", amount, status, u) for i, (s, amount, status, _, u) in enumerate(rows)))
    for user in {r[4] for r in rows}:
        mine = [r for r in ordered if r[4] == user]
        for i, start in enumerate(mine):
            if not stages[0][0](start):
                continue
            wanted = [cond for cond, times in stages for _ in range(times)]
            last = None
            for row in mine[i:]:
                if wanted and wanted[0](row):
                    wanted, last = wanted[1:], row
            if not wanted and last[0] - start[0] < within:
                found.append((start[1], last[1]))
    return sorted(found)


STAGES = [
    ([("status = 'completed'", lambda r: r[3] == "completed", 5)], 60),
    ([("amount >= 1000", lambda r: r[2] >= 1000, 1), ("amount <= 50", lambda r: r[2] <= 50, 3)], 90),
    ([("status = 'failed'", lambda r: r[3] == "failed", 3), ("status = 'completed'", lambda r: r[3] == "completed", 1)], 40),
    ([("amount = 5", lambda r: r[2] == 5, 2), ("status = 'failed'", lambda r: r[3] == "failed", 2),
      ("amount > 100", lambda r: r[2] > 100, 2)], 120),
]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("which", range(len(STAGES)))
def test_sequences(spark, both, seed, which):
    stages, within = STAGES[which]
    rows = rows_of(seed)
    found = patterns.sequence(transactions(spark, rows), [
        patterns.Stage(f"s{i}", F.expr(text), n) for i, (text, _, n) in enumerate(stages)],
        f"{within} seconds", "userId", "transactionId")
    want = match(rows, [(cond, n) for _, cond, n in stages], within)
    assert want and sorted((r.transactionId, r.endId) for r in found.collect()) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_asof(spark, both, seed):
    r = random.Random(seed)
    left = [(r.randrange(0, 300), 1, "completed", "US", r.choice("aab")) for _ in range(60)]
    right = [(r.randrange(0, 300), "x", "s", r.choice("aab")) for _ in range(25)]
    out = joins.asof_join(transactions(spark, left), events(spark, right), "userId", "e", "eventId", how="left")
    got = sorted((row.transactionId, row.e.eventId if row.e else None) for row in out.collect())
    want = []
    for i, (s, _, _, _, u) in enumerate(left):
        hits = [(t, j) for j, (t, _, _, v) in enumerate(right) if v == u and t <= s]
        want.append((f"t{i:03d}", max(hits)[1] if hits else None))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_sessions(spark, both, seed):
    r = random.Random(seed)
    rows = [(r.randrange(0, 200) * 100, "x", r.choice("pq"), r.choice("aaab")) for _ in range(80)]
    got = sorted((s.userId, s.sessionId, s.eventCount, s.status) for s in keyed.sessions(events(spark, rows), "10 minutes").collect())
    want, newest = [], max(t for t, *_ in rows)
    for user in "ab":
        mine = sorted((t, i, s) for i, (t, _, s, u) in enumerate(rows) if u == user)
        run = []
        for t, _, s in [*mine, (None, None, None)]:
            if run and (t is None or s != run[-1][1] or t - run[-1][0] >= 600):
                gap = (newest - 10 if t is None else t) - run[-1][0]
                status = "timeout" if gap >= 600 else "active" if t is None else "ended"
                want.append((user, run[0][1], len(run), status))
                run = []
            run.append((t, s))
    assert got == sorted(want)


def test_zscore(spark, both):
    r = random.Random(7)
    rows = [(i, r.gauss(20, 1) + (15 if i % 17 == 0 else 0), r.choice("sst")) for i in range(300)]
    out = keyed.zscore_alerts(readings(spark, rows), n=20).collect()
    want = []
    for sensor in "st":
        seen = []
        for i, (_, v, who) in enumerate(rows):
            if who == sensor:
                seen = [*seen, v][-20:]
                mean = sum(seen) / len(seen)
                std = (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5
                if len(seen) >= 10 and abs(v - mean) / std > 2.5:
                    want.append((i, round(abs(v - mean) / std, 9)))
    assert want and sorted((a.readingId, round(a.zScore, 9)) for a in out) == sorted(want)
