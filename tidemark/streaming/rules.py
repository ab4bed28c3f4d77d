"""The keyed operators and patterns as rules over rows in order. Each is the streaming twin of a table operator."""

from __future__ import annotations

from collections import deque

import math

from pyspark.sql import types as T

from tidemark.streaming.ordered import Rule
from tidemark.streaming.slices import Fold


class Sessions(Rule):
    columns = ["sessionId"]
    memory = "sessionId STRING, start BIGINT, last BIGINT, events INT"
    output = "sessionId STRING, start BIGINT, last BIGINT, eventCount INT, status STRING"

    def __init__(self, gap: int):
        self.gap = gap

    def step(self, memory, row):
        at, _, session = row
        if memory is not None:
            timed_out = at - memory[2] >= self.gap
            if not timed_out and memory[0] == session:
                return (session, memory[1], at, memory[3] + 1), []
            return (session, at, at, 1), [(*memory, "timeout" if timed_out else "ended")]
        return (session, at, at, 1), []

    def wake(self, memory):
        return None if memory is None else memory[2] + self.gap

    def idle(self, memory, now):
        return None, [(*memory, "timeout")]


class ZScore(Rule):
    columns = ["value"]
    memory = "history ARRAY<DOUBLE>"
    output = "readingId BIGINT, p BIGINT, value DOUBLE, readings INT, mean DOUBLE, zScore DOUBLE"

    def __init__(self, n: int = 100, min_n: int = 10, z: float = 2.5):
        self.n, self.min_n, self.z = n, min_n, z

    def step(self, memory, row):
        at, ident, value = row
        history = [*(memory[0] if memory else []), value][-self.n:]
        out = []
        if len(history) >= self.min_n:
            mean = math.fsum(history) / len(history)
            std = math.sqrt(math.fsum((v - mean) ** 2 for v in history) / len(history))
            if std > 0 and abs(value - mean) / std > self.z:
                out.append((ident, at, value, len(history), mean, abs(value - mean) / std))
        return (history,), out


class RapidChange(Rule):
    columns = ["value"]
    memory = "p BIGINT, value DOUBLE"
    output = "readingId BIGINT, p BIGINT, value DOUBLE, previousValue DOUBLE, relativeChange DOUBLE, seconds DOUBLE"

    def __init__(self, max_dt: int, rel: float = 0.5):
        self.max_dt, self.rel = max_dt, rel

    def step(self, memory, row):
        at, ident, value = row
        out = []
        if memory is not None and 0 < at - memory[0] < self.max_dt:
            change = abs(value - memory[1])
            rel = change / abs(memory[1]) if memory[1] else (math.inf if change else 0.0)
            if rel > self.rel:
                out.append((ident, at, value, memory[1], rel, (at - memory[0]) / 1e6))
        return (at, value), out


class DataGaps(Rule):
    memory = "p BIGINT"
    output = "readingId BIGINT, p BIGINT, minutes DOUBLE"

    def __init__(self, timeout: int):
        self.timeout = timeout

    def step(self, memory, row):
        at, ident = row
        late = memory is not None and at - memory[0] > self.timeout
        return (at,), [(ident, at, (at - memory[0]) / 6e7)] if late else []


class Offline(Rule):
    memory = "p BIGINT, readingId BIGINT, told BOOLEAN"
    output = "readingId BIGINT, lastSeen BIGINT, p BIGINT"

    def __init__(self, timeout: int):
        self.timeout = timeout

    def _tell(self, memory):
        return memory[1], memory[0], memory[0] + self.timeout

    def step(self, memory, row):
        at, ident = row
        missed = memory is not None and not memory[2] and at - memory[0] > self.timeout
        return (at, ident, False), [self._tell(memory)] if missed else []

    def wake(self, memory):
        return None if memory is None or memory[2] else memory[0] + self.timeout

    def idle(self, memory, now):
        return (memory[0], memory[1], True), [self._tell(memory)]


class VelocityCount(Rule):
    memory = "times ARRAY<BIGINT>"
    output = "transactionId STRING, p BIGINT, transactionCount INT"

    def __init__(self, window: int, more_than: int = 5):
        self.window, self.more_than = window, more_than

    def step(self, memory, row):
        at, ident = row
        times = memory[0] if memory else deque()
        if not isinstance(times, deque):  # as it comes from the state
            times = deque(times)
        while times and at - times[0] > self.window:
            times.popleft()
        times.append(at)
        return (times,), [(ident, at, len(times))] if len(times) > self.more_than else []


class RateLimit(Rule):
    memory = "unit BIGINT, events INT"
    output = "transactionId STRING, p BIGINT"

    def __init__(self, per: int = 60_000_000, n: int = 100):
        self.per, self.n = per, n

    def step(self, memory, row):
        at, ident = row
        unit = at // self.per
        count = memory[1] + 1 if memory is not None and memory[0] == unit else 1
        return (unit, count), [(ident, at)] if count <= self.n else []


class RunningStats(Rule):
    """Counts lie in a map of the state, one entry per action, so a row reads and writes its own action's only.

    ``live``: an action not seen for so long (event time) starts again from 1; its entry is taken away at the next sweep,
    of which there is one in that time while the key has entries. ``live`` None keeps counts as long as the key is known.
    """

    columns = ["action"]
    memory = "last BIGINT, sweep BIGINT"
    entries = ("STRING", "n BIGINT, seen BIGINT")
    output = "eventId BIGINT, p BIGINT, action STRING, lastProcessingInterval BIGINT, eventTypeCount BIGINT"

    def __init__(self, live: int | None = None):
        self.live = live

    def _over(self, seen: int, now: int) -> bool:
        return self.live is not None and now - seen >= self.live

    def step(self, memory, row):
        at, ident, action = row
        action = action or "unknown"
        have = self.kept.get(action)
        n = 1 if have is None or self._over(have[1], at) else have[0] + 1
        self.kept.put(action, (n, at))
        last, sweep = memory or (None, None)
        if sweep is None and self.live is not None:
            sweep = at + self.live
        return (at, sweep), [(ident, at, action, 0 if last is None else at // 1000 - last // 1000, n)]

    def wake(self, memory):
        return memory[1] if memory else None

    def idle(self, memory, now):
        seen = []
        for action, (_, at) in self.kept.items():
            if self._over(at, now):
                self.kept.put(action, None)
            else:
                seen.append(at)
        return (memory[0], min(seen) + self.live if seen else None), []


class CountBatches(Rule):
    columns = ["value"]
    memory = "batch BIGINT, ids ARRAY<BIGINT>, readings ARRAY<DOUBLE>, since BIGINT"
    output = "kind STRING, readingId BIGINT, batch BIGINT, batchSize INT, batchAverage DOUBLE"

    def __init__(self, size: int = 100, timeout: int | None = None):
        self.size, self.timeout = size, timeout

    def _flush(self, memory):
        number, ids, values, _ = memory
        mean = math.fsum(values) / len(values)
        rows = [("row", i, number, len(ids), mean) for i in ids]
        return (number + 1, [], [], None), [("summary", None, number, len(ids), mean), *rows]

    def step(self, memory, row):
        at, ident, value = row
        number, ids, values, since = memory or (0, [], [], None)
        memory = (number, [*ids, ident], [*values, value], at if since is None else since)
        return self._flush(memory) if len(memory[1]) >= self.size else (memory, [])

    def wake(self, memory):
        return memory[3] + self.timeout if self.timeout and memory and memory[3] is not None else None

    def idle(self, memory, now):
        return self._flush(memory)


class Numbered(Rule):
    """Rows in batches of ``size``, numbered on from what came before."""

    columns = ["value"]
    memory = "n BIGINT"
    output = "batch BIGINT, readingId BIGINT, p BIGINT, value DOUBLE"

    def __init__(self, size: int):
        self.size = size

    def step(self, memory, row):
        at, ident, value = row
        n = memory[0] if memory else 0
        return (n + 1,), [(n // self.size, ident, at, value)]


class Counted(Fold):
    def add(self, carried, summary):
        return ((carried[0] if carried else 0) + summary[0],)


class CountryChange(Rule):
    columns = ["country"]
    memory = "p BIGINT, transactionId STRING, country STRING"
    output = "transactionId STRING, p BIGINT, country STRING, nextCountry STRING, endId STRING, endP BIGINT"

    def __init__(self, within: int):
        self.within = within

    def step(self, memory, row):
        at, ident, country = row
        moved = memory is not None and at - memory[0] < self.within and memory[2] != country
        return (at, ident, country), [(memory[1], memory[0], memory[2], country, ident, at)] if moved else []


class Sequence(Rule):
    """Open matches of a key, a queue for each stage; the oldest falls out after ``within``.

    A row that meets a stage moves every match that waits there by one, so nothing is told to the matches themselves: the stage
    counts its rows and adds up their amounts, and a match keeps what both were when it came. Those that came first have
    their rows first and are the oldest, so only the heads of the queues are looked at, however many matches are open.
    """

    columns = ["flags", "amount"]
    memory = ("queues ARRAY<ARRAY<STRUCT<p: BIGINT, id: STRING, rows: BIGINT, amount: DOUBLE, rest: DOUBLE, totals: ARRAY<DOUBLE>>>>, "
              "rows ARRAY<BIGINT>, amounts ARRAY<DOUBLE>, rests ARRAY<DOUBLE>")
    output = "startId STRING, startP BIGINT, endId STRING, endP BIGINT, totals ARRAY<DOUBLE>"

    def __init__(self, times: list[int], within: int):
        self.times, self.within = times, within

    def _open(self, memory):
        """Queues and running numbers that may be changed; those of the state are lists."""
        n = len(self.times)
        if memory is None:
            return [deque() for _ in range(n)], [0] * n, [0.0] * n, [0.0] * n
        queues, *running = memory
        if queues and not isinstance(queues[0], deque):
            queues = [deque(tuple(m) for m in q) for q in queues]
        return (queues, *running)

    @staticmethod
    def _forget(queues, until):
        for queue in queues:
            while queue and queue[0][0] <= until:
                queue.popleft()

    def step(self, memory, row):
        at, ident, flags, amount = row
        queues, rows, amounts, rests = self._open(memory)
        self._forget(queues, at - self.within)
        if flags[0]:
            queues[0].append((at, ident, rows[0], amounts[0], rests[0], []))
        for stage, met in enumerate(flags):
            if met:
                rows[stage] += 1
                # The part of the amount that the sum cannot hold is added up beside it, so differences lose nothing.
                have, more = amounts[stage], amount or 0.0
                both = have + more
                kept = both - have
                amounts[stage] = both
                rests[stage] += (have - (both - kept)) + (more - kept)
        out = []
        for stage in reversed(range(len(self.times))):  # a row moves a match by one stage at most
            while queues[stage] and rows[stage] >= queues[stage][0][2] + self.times[stage]:
                start, name, _, had, beside, totals = queues[stage].popleft()
                totals = [*totals, (amounts[stage] - had) + (rests[stage] - beside)]
                if stage + 1 < len(self.times):
                    queues[stage + 1].append((start, name, rows[stage + 1], amounts[stage + 1], rests[stage + 1], totals))
                else:
                    out.append((name, start, ident, at, totals))
        return ((queues, rows, amounts, rests) if any(queues) else None), out

    def wake(self, memory):
        return min(q[0][0] for q in memory[0] if q) + self.within if memory else None

    def idle(self, memory, now):
        queues, *running = self._open(memory)
        self._forget(queues, now - self.within)
        return ((queues, *running) if any(queues) else None), []


class AsOf(Rule):
    """Rows of two sides: 0 is remembered, 1 is given out with what is remembered unless that is older than ``tolerance``."""

    columns = ["payload"]

    def __init__(self, left: str, right: str, inner: bool = True, tolerance: int | None = None):
        self.inner, self.tolerance = inner, tolerance
        self.memory = f"hit {right}, p BIGINT"
        self.output = f"leftRow {left}, hit {right}"

    def step(self, memory, row):
        at, (side, _), (left, right) = row
        if side == 0:
            return (tuple(right), at), []
        if memory is None or (self.tolerance is not None and at - memory[1] > self.tolerance):
            return memory, [] if self.inner else [(tuple(left), None)]
        return memory, [(tuple(left), tuple(memory[0]))]


class LatestHit(Fold):
    """The latest right row of a slice, where it has one; ``AsOf`` starts from it."""

    def add(self, carried, summary):
        return carried if summary[0] is None else summary[0]


class Together(Rule):
    """Several rules over one buffer. ``use`` says per row which of them see it; outputs come as one struct each.

    ``carry``: columns (with their types) of the row at hand that go out beside each output as the struct ``row``, null
    where time alone made the output.
    """

    def __init__(self, parts: list[tuple[Rule, list[str]]], carry: dict[str, str] | None = None):
        self.parts, self.carry = parts, carry or {}
        self.columns = ["use", *dict.fromkeys([*(c for _, names in parts for c in names), *self.carry])]
        self.memory = ", ".join(f"m{i} {self._struct(r.memory)}" for i, (r, _) in enumerate(parts))
        self.output = ", ".join(f"o{i} {self._struct(r.output)}" for i, (r, _) in enumerate(parts))
        if self.carry:
            self.output += ", row " + self._struct(", ".join(f"{n} {t}" for n, t in self.carry.items()))

    @staticmethod
    def _struct(ddl: str) -> str:
        return T.StructType.fromDDL(ddl).simpleString()

    def _merge(self, each: list[tuple[tuple | None, list[tuple]]], have: dict | None = None) -> tuple[tuple | None, list[tuple]]:
        memory = tuple(m for m, _ in each)
        beside = (tuple(have[n] for n in self.carry) if have else None,) if self.carry else ()
        rows = [(*(o if j == i else None for j in range(len(each))), *beside) for i, (_, outs) in enumerate(each) for o in outs]
        return (memory if any(m is not None for m in memory) else None), rows

    def step(self, memory, row):
        at, ident, use, *values = row
        have = dict(zip(self.columns[1:], values))
        old = memory or (None,) * len(self.parts)
        return self._merge([
            rule.step(old[i], (at, ident, *[have[n] for n in names])) if use[i] else (old[i], [])
            for i, (rule, names) in enumerate(self.parts)], have)

    def wake(self, memory):
        times = [rule.wake(m) for (rule, _), m in zip(self.parts, memory or ())]
        return min((t for t in times if t is not None), default=None)

    def idle(self, memory, now):
        each = []
        for (rule, _), m in zip(self.parts, memory):
            due = rule.wake(m)
            each.append(rule.idle(m, now) if due is not None and due <= now else (m, []))
        return self._merge(each)


class Profile(Rule):
    """What was known of a user before each transaction, for the risk score. Memory has an entry for each category of the user."""

    columns = ["amount", "country", "merchantCategory", "isFraud", "paymentMethod"]
    memory = "p BIGINT, frauds BIGINT, paid DOUBLE, priced BIGINT, home STRING, counts MAP<STRING, BIGINT>"
    output = ("transactionId STRING, p BIGINT, amount DOUBLE, country STRING, merchantCategory STRING, isFraud BOOLEAN, "
              "paymentMethod STRING, elapsed BIGINT, averageAmount DOUBLE, homeCountry STRING, usualCategory BOOLEAN, priorFrauds BIGINT")

    def __init__(self, categories: int = 3):
        self.categories = categories

    def step(self, memory, row):
        at, ident, amount, country, category, fraud, method = row
        first = memory is None
        last, frauds, paid, priced, home, counts = memory or (None, 0, 0.0, 0, country, {})
        usual = None
        if category is not None:
            have = counts.get(category, 0)
            usual = None if first else have > 0 and sum(n > have for n in counts.values()) < self.categories
            counts[category] = have + 1
        made = (ident, at, amount, country, category, fraud, method, None if first else at - last,
                paid / priced if priced else None, None if first else home, usual, frauds)
        known = (at, frauds + bool(fraud), paid + (amount or 0.0), priced + (amount is not None), home, counts)
        return known, [made]
