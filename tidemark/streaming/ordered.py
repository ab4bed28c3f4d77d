"""Streams in event-time order: rows wait until the watermark has passed them, then a rule sees them one by one.

So a streaming rule gives the rows its table form gives, whatever order messages arrive in. Per key the state
holds the waiting rows of one watermark delay, a small memory of the rule, and one timer. Waiting rows lie in a map by
time bucket, some eight to a delay: rows that come are added as a part of their bucket and nothing else is read or
written, and a timer reads the buckets that are due.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.times import late_filter, micros


#: Buckets of waiting rows in one watermark delay.
BUCKETS = 8


class Rule:
    """What to do with the rows of a key. Memory is a tuple, or None at first; times are microseconds.

    ``columns`` are the input columns a row brings after its time and id; ``memory`` and ``output`` are DDL.
    """

    columns: list[str] = []
    memory: str = ""
    output: str = ""
    #: Types (DDL) of the key and the value of a map that a rule keeps beside its memory, one entry read or written at a time.
    entries: tuple[str, str] | None = None
    kept: "Entries"

    def step(self, memory: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def wake(self, memory: tuple | None) -> int | None:
        """When to call ``idle`` if no row comes before."""
        return None

    def idle(self, memory: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        return memory, []


class Entries:
    """The map of a rule for the key at hand; what is read or changed during one call goes to the state once, at its end."""

    def __init__(self, state):
        self.state, self.seen, self.changed = state, {}, set()

    def get(self, key) -> tuple | None:
        if key not in self.seen:
            found = self.state.getValue((key,))
            self.seen[key] = None if found is None else tuple(found)
        return self.seen[key]

    def put(self, key, value: tuple | None) -> None:
        """None takes the entry away."""
        self.seen[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple]:
        have = {tuple(k)[0]: tuple(v) for k, v in self.state.iterator()}
        return [(k, v) for k, v in {**have, **self.seen}.items() if v is not None]

    def clear(self) -> None:
        self.seen, self.changed = {}, set()
        self.state.clear()

    def flush(self) -> None:
        for key in self.changed:
            if self.seen[key] is not None:
                self.state.updateValue((key,), self.seen[key])
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.seen, self.changed = {}, set()


def _plain(value):
    """Rows as tuples, which is what state takes."""
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    return [_plain(v) for v in value] if isinstance(value, (list, deque)) else value


def shaped(value, kind: T.DataType):
    """A value as Arrow hands it over (structs as dicts, maps as pairs) in the form the state takes: tuples and dicts."""
    if value is None or not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return value
    if isinstance(kind, T.StructType):
        return tuple(shaped(value[f.name], f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [shaped(v, kind.elementType) for v in value]
    return {k: shaped(v, kind.valueType) for k, v in (value.items() if isinstance(value, dict) else value)}


def _place(row: tuple) -> tuple:
    """Time, then id; rows without an id come first."""
    return row[0], row[1] is not None, row[1] if row[1] is not None else ""


class InOrder(StatefulProcessor):
    """``width``: microseconds of a bucket of waiting rows."""

    def __init__(self, rule: Rule, row: T.StructType, output_names: list[str], forget: int | None, width: int):
        self.rule, self.row = rule, row
        self.output_names, self.forget, self.width = output_names, forget, width

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket BIGINT, part INT", f"rows ARRAY<{self.row.simpleString()}>")
        self.memory = handle.getValueState("memory", self.rule.memory)
        self.clock = handle.getValueState(
            "clock", "timer BIGINT, last BIGINT, buckets ARRAY<STRUCT<bucket: BIGINT, parts: INT, first: BIGINT>>")
        if self.rule.entries is not None:
            of, to = self.rule.entries
            self.rule.kept = Entries(handle.getMapState("kept", f"entry {of}", to))

    def _clock(self) -> tuple[int | None, int | None, dict[int, tuple[int, int]]]:
        """The timer, the time of the last row, and (parts, first time) of each bucket that waits."""
        if not self.clock.exists():
            return None, None, {}
        timer, last, buckets = self.clock.get()
        return timer, last, {b: (parts, first) for b, parts, first in buckets or ()}

    def _keep_clock(self, timer: int | None, last: int | None, buckets: dict, times: list[int]) -> None:
        """One timer per key, at the earliest time anything is due."""
        at = -(-min(times) // 1000) if times else None
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is None:
            self.clock.clear()
            return
        if timer != at:
            self.handle.registerTimer(at)
        self.clock.update((at, last, [(b, parts, first) for b, (parts, first) in buckets.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came: dict[int, list[tuple]] = {}
        for row in rows:
            value = shaped(row, self.row)
            came.setdefault(value[0] // self.width, []).append(value)
        if came:
            timer, last, buckets = self._clock()
            for bucket, values in came.items():
                parts, first = buckets.get(bucket, (0, values[0][0]))
                self.waiting.updateValue((bucket, parts), (values,))
                buckets[bucket] = (parts + 1, min(first, *(v[0] for v in values)))
            due = [first for _, first in buckets.values()]
            self._keep_clock(timer, last, buckets, due if timer is None else [*due, timer * 1000])
        return iter(())

    def _take(self, buckets: dict[int, tuple[int, int]], now: int) -> list[tuple]:
        """The rows up to now, out of the state; later ones of the bucket that now lies in go back."""
        due = []
        for bucket in [b for b, (_, first) in buckets.items() if first <= now]:
            parts, _ = buckets.pop(bucket)
            held = []
            for part in range(parts):
                held += [_plain(r) for r in self.waiting.getValue((bucket, part))[0]]
                self.waiting.removeKey((bucket, part))
            rest = [r for r in held if r[0] > now]
            if rest:
                self.waiting.updateValue((bucket, 0), (rest,))
                buckets[bucket] = (1, min(r[0] for r in rest))
            due += [r for r in held if r[0] <= now]
        return sorted(due, key=_place)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        _, last, buckets = self._clock()
        memory = _plain(self.memory.get()) if self.memory.exists() else None
        out: list[tuple] = []
        for row in self._take(buckets, now):
            memory, made = self.rule.step(memory, row)
            out += made
            last = row[0]
        wake = self.rule.wake(memory)
        if wake is not None and wake <= now:
            memory, made = self.rule.idle(memory, now)
            out += made
            wake = self.rule.wake(memory)
        if self.rule.entries is not None:
            self.rule.kept.flush()
        if self.forget is not None and last is not None and last + self.forget <= now:
            memory = None
            if self.rule.entries is not None:
                self.rule.kept.clear()
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update(_plain(memory))
        times = [first for _, first in buckets.values()] + [t for t in (wake,) if t is not None and memory is not None]
        if self.forget is not None and memory is not None and last is not None:
            times.append(last + self.forget)
        self._keep_clock(None, last, buckets, times)
        named = Row(*self.output_names)
        return iter([named(*key, *values) for values in out])

    def close(self) -> None:
        pass


def in_order(df: DataFrame, key: str, rule: Rule, tiebreak: Column | str, ts: str = "ts", delay: str = "10 seconds",
             forget: str | None = None, where: Column | None = None, **computed: Column) -> DataFrame:
    """The rule's output per key. ``forget`` drops the memory of keys idle for that long; ``computed`` adds columns
    for the rule that Spark works out beforehand. Rows that fail ``where`` are left out but move the watermark."""
    tie = F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak
    marked = df.withWatermark(ts, delay)
    if where is not None:
        marked = late_filter(marked, where, ts)
    work = marked.select(F.col(key), F.col(ts), F.unix_micros(ts).alias("_p"), tie.alias("_id"),
                         *[(computed[c] if c in computed else F.col(c)).alias(c) for c in rule.columns])
    names = ["_p", "_id", *rule.columns]
    row = work.select(*names).schema
    output = T.StructType.fromDDL(f"{key} {work.schema[key].dataType.simpleString()}, {rule.output}")
    processor = InOrder(rule, row, output.names, micros(forget) if forget else None,
                        max(1, micros(delay) // BUCKETS))
    return work.groupBy(key).transformWithState(processor, output, "Append", "EventTime")
