"""Rules over rows in order whose keys are few: a key's rows are spread over tasks by time slice.

What a rule must know of earlier rows is small (a count, the latest row), and it is found out apart from the rows: a
plain windowed aggregation sums each slice of a key up, one small state per key carries the sums from slice to slice, and each
slice, which is a group of its own, runs the rule over its rows from what was carried to it. So no task sees all rows of a
key; the one that carries sees one row for each slice. All three happen in the trigger in which the watermark passes the slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.times import micros
from tidemark.streaming.ordered import Rule, _place, _plain, shaped


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Fold:
    """How sums of slices follow each other. ``memory`` is the rule's; what is carried is a tuple of it, or None at first."""

    def add(self, carried: tuple | None, summary: tuple) -> tuple | None:
        raise NotImplementedError


class Carry(StatefulProcessor):
    """For each slice of a key, in order, what its earlier slices left. It is dated just past the watermark, as a row may be that
    goes on to the next operator."""

    def __init__(self, fold: Fold, memory: T.StructType, summary: T.DataType, names: list[str]):
        self.fold, self.memory, self.summary, self.names = fold, memory, summary, names

    def init(self, handle) -> None:
        self.carried = handle.getValueState("carried", self.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        carried = _plain(self.carried.get()) if self.carried.exists() else None
        named, out = Row(*self.names), []
        for slice_, end, summary in sorted((row["_slice"], row["_end"], shaped(row["_sum"], self.summary)) for row in rows):
            out.append(named(*key, slice_, EPOCH + timedelta(microseconds=max(at, end)), carried))
            carried = self.fold.add(carried, summary)
        if carried is not None:
            self.carried.update(carried)
        return iter(out)

    def close(self) -> None:
        pass


class Slices(StatefulProcessor):
    """The rule over one slice's rows, once what was carried to it is there: all its rows are by then, later ones are late."""

    def __init__(self, rule: Rule, row: T.StructType, memory: T.StructType, output_names: list[str]):
        self.rule, self.row, self.memory, self.output_names = rule, row, memory, output_names

    def init(self, handle) -> None:
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came, memory, due = [], None, False
        for row in rows:
            if row["_row"] is None:
                memory, due = shaped(row["_carried"], self.memory), True
            else:
                came.append(shaped(row["_row"], self.row))
        if not due:
            self.waiting.appendList(came)
            return iter(())
        held = sorted([*(_plain(r) for r in self.waiting.get()), *came], key=_place)
        self.waiting.clear()
        named, out = Row(*self.output_names), []
        for row in held:
            memory, made = self.rule.step(memory, row)
            out += [named(key[0], *values) for values in made]
        return iter(out)

    def close(self) -> None:
        pass


class FullBatches(StatefulProcessor):
    """The rows of one batch, which come from several slices, until it is full: then each with the mean, and a summary."""

    def __init__(self, size: int, output_names: list[str]):
        self.size, self.output_names = size, output_names

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", "p BIGINT, readingId BIGINT, value DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [*(_plain(r) for r in self.rows.get()), *((r["p"], r["readingId"], r["value"]) for r in rows)]
        if len(held) < self.size:
            self.rows.put(held)
            return iter(())
        self.rows.clear()
        kind, batch = key
        mean = math.fsum(v for _, _, v in held) / self.size
        named = Row(*self.output_names)
        told = [named(kind, "row", ident, batch, self.size, mean) for _, ident, _ in sorted(held, key=_place)]
        return iter([named(kind, "summary", None, batch, self.size, mean), *told])

    def close(self) -> None:
        pass


def in_slices(df: DataFrame, key: str, rule: Rule, fold: Fold, summary: Column, tiebreak: Column | str, width: str,
              ts: str = "ts", delay: str = "10 seconds", **computed: Column) -> DataFrame:
    """The rule's output per key, as ``ordered.in_order`` gives it, with a key's rows spread by slices of ``width``.

    ``summary`` is an aggregate over ``_p`` (microseconds), ``_id`` (the tiebreak) and the rule's columns, from which
    ``fold`` makes the memory that the rule starts the next slice with. The rule must not ask to be woken.
    """
    if micros(width) % 1000:
        raise ValueError("slices are whole milliseconds wide")
    tie = F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak
    work = df.withWatermark(ts, delay).select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.unix_micros(ts).alias("_p"), tie.alias("_id"),
        *[(computed[c] if c in computed else F.col(c)).alias(c) for c in rule.columns])
    names = ["_p", "_id", *rule.columns]
    kind = work.schema["_key"].dataType.simpleString()
    row, memory = work.select(*names).schema, T.StructType.fromDDL(rule.memory)
    at = F.floor(F.col("_p") / micros(width))
    sums = (work.groupBy(F.window("_ts", width).alias("_window"), "_key").agg(F.min("_p").alias("_p"), summary.alias("_sum"))
            .select("_key", F.window_time("_window").alias("_ts"), at.alias("_slice"),
                    F.unix_micros("_window.end").alias("_end"), F.struct(F.col("_sum")).alias("_sum")))
    out = T.StructType.fromDDL(f"_key {kind}, _slice BIGINT, _ts TIMESTAMP, _carried {memory.simpleString()}")
    told = sums.groupBy("_key").transformWithState(
        Carry(fold, memory, sums.schema["_sum"].dataType, out.names), out, "Append", "EventTime", eventTimeColumnName="_ts")
    rows = work.select("_key", at.alias("_slice"), "_ts", F.struct(*names).alias("_row"), F.lit(None).cast(memory).alias("_carried"))
    both = rows.unionByName(told.withColumn("_row", F.lit(None).cast(row)))
    output = T.StructType.fromDDL(f"{key} {kind}, {rule.output}")
    return both.groupBy("_key", "_slice").transformWithState(Slices(rule, row, memory, output.names), output, "Append", "EventTime")
