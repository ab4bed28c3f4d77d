"""The streaming sequence rule against a walk over all open matches, and what a row costs it."""

import random
import time

import pytest

from tidemark.streaming.ordered import _plain
from tidemark.streaming.rules import Profile, Sequence


def walk(rows, times, within):
    """Every open match is told of every row."""
    matches, out = [], []
    for at, ident, flags, amount in rows:
        matches = [m for m in matches if at - m["p"] < within]
        if flags[0]:
            matches.append({"p": at, "id": ident, "stage": 0, "seen": 0, "totals": [0.0] * len(times)})
        for m in matches:
            if flags[m["stage"]]:
                m["totals"][m["stage"]] += amount or 0.0
                m["seen"] += 1
                if m["seen"] == times[m["stage"]]:
                    m["stage"], m["seen"] = m["stage"] + 1, 0
                    if m["stage"] == len(times):
                        out.append((m["id"], m["p"], ident, at, m["totals"]))
        matches = [m for m in matches if m["stage"] < len(times)]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_sequence_rule(seed):
    r = random.Random(seed)
    times = [r.randrange(1, 4) for _ in range(r.randrange(1, 4))]
    within, at, rows = r.choice([5, 30, 1000]), 0, []
    for i in range(400):
        at += r.randrange(0, 3)
        rows.append((at, f"t{i}", [r.random() < 0.4 for _ in times], r.choice([None, 0.1, 1e9 + 0.3, 25.0])))
    rule, memory, got = Sequence(times, within), None, []
    for row in rows:
        memory, out = rule.step(memory, row)
        got += out
        if r.random() < 0.2:  # as it comes back from the state
            memory = memory and _plain(memory)
        if memory and r.random() < 0.1:
            assert rule.wake(memory) > row[0]
            memory, none = rule.idle(memory, row[0])
            assert not none
    want = walk(rows, times, within)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], rel=1e-12)
    assert memory is None or rule.idle(memory, rows[-1][0] + within) == (None, [])


def test_totals_lose_no_cents():
    """A small match after amounts of another size."""
    rule, memory = Sequence([2, 1], 1000), None
    for row in [(0, "a", [True, False], 1e15), (1, "b", [True, False], 0.1), (2, "c", [True, False], 0.2)]:
        memory, _ = rule.step(memory, row)
    _, out = rule.step(memory, (3, "d", [False, True], 0.7))
    assert [o[0] for o in out] == ["a", "b"] and out[1][4] == [pytest.approx(0.3, rel=1e-12), 0.7]


def test_a_row_costs_the_same_however_many_matches_are_open():
    def seconds(n):
        rule, memory = Sequence([1, 3], 10 ** 9), None
        rows = [(i, str(i), [True, False], 1.0) for i in range(n)]
        began = time.process_time()
        for row in rows:
            memory, _ = rule.step(memory, row)
        assert len(memory[0][1]) == n
        return time.process_time() - began

    few, many = min(seconds(4000) for _ in range(5)), min(seconds(8000) for _ in range(5))
    assert many < 3 * few


def test_profile_rule():
    rule, memory, got = Profile(1), None, []
    for i, (category, amount) in enumerate([("a", 10.0), ("b", None), ("b", 30.0), ("a", 5.0), (None, 1.0), ("a", 2.0), ("b", 2.0)]):
        memory, out = rule.step(memory and _plain(memory), (i, f"t{i}", amount, "US", category, i == 2, None))
        got += out
    assert [g[10] for g in got] == [None, False, True, False, None, True, False]
    assert [g[8] for g in got][:4] == [None, 10.0, 10.0, 20.0] and [g[11] for g in got] == [0, 0, 0, 1, 1, 1, 1]
