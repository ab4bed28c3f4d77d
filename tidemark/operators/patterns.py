"""Ordered event patterns per key.

Relaxed contiguity and no skipping: every row that meets the first stage starts at most one match, each stage
takes the next rows that meet it, and the last row must come less than ``within`` after the first. Rows of one
instant are ordered by id. All stages share one shuffle by (key, slice); a slice sees ``within`` beyond its end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import is_off_hours, micros
from tidemark.operators import slicing as S


@dataclass(frozen=True)
class Stage:
    """``times`` rows that meet ``cond``; the sum of ``amount`` over them comes out as ``<name>Total``."""

    name: str
    cond: Column
    times: int = 1


class Pattern:
    """A sequence under construction: ``begin(..).where(..).followed_by(..).where(..).times(3).within(..)``."""

    def __init__(self, stages: tuple[Stage, ...] = (), span: str | None = None):
        self.stages, self.span = stages, span

    @classmethod
    def begin(cls, name: str) -> Pattern:
        return cls((Stage(name, F.lit(True)),))

    def _last(self, **change: object) -> Pattern:
        old = self.stages[-1]
        new = Stage(**{"name": old.name, "cond": old.cond, "times": old.times, **change})
        return Pattern((*self.stages[:-1], new), self.span)

    def where(self, cond: Column) -> Pattern:
        return self._last(cond=self.stages[-1].cond & cond)

    def times(self, n: int) -> Pattern:
        return self._last(times=n)

    def followed_by(self, name: str) -> Pattern:
        return Pattern((*self.stages, Stage(name, F.lit(True))), self.span)

    def within(self, span: str) -> Pattern:
        return Pattern(self.stages, span)

    def select(self, df: DataFrame, key: str, tiebreak: str, amount: str = "amount") -> DataFrame:
        if self.span is None:
            raise ValueError("a pattern needs a time limit")
        return sequence(df, list(self.stages), self.span, key, tiebreak, amount)


def sequence(df: DataFrame, stages: list[Stage], within: str, key: str, tiebreak: str,
             amount: str = "amount") -> DataFrame:
    """One row per match: the starting row's columns, ``startTs``, ``endTs``, ``endId`` and a total per stage."""
    span = micros(within)
    wanted = reduce(lambda a, b: a | b, [F.coalesce(s.cond, F.lit(False)) for s in stages])
    placed = S.place(df.where(wanted), [key], F.unix_micros("ts"))
    totals = [F.col("_to.totals")[i].alias(f"{s.name}Total") for i, s in enumerate(stages)]
    out = [*df.columns, F.col("ts").alias("startTs"), F.col("_to.ts").alias("endTs"), F.col("_to.id").alias("endId"), *totals]
    quiet = placed if placed.busy is None else placed.with_rows(placed.rows.where("NOT _hot"))
    sliced = S.by_slice(quiet) if len(stages) > 1 else quiet.rows
    matches = add_matches(sliced, stages, span, [key], tiebreak, amount, "_to").where(F.col("_to").isNotNull()).select(*out)
    if placed.busy is None:
        return matches
    ranked = rank_rows(placed, {"_to": stages}, [key], tiebreak)
    ends = matches_by_rank(ranked, stages, span, [key], tiebreak, amount, "_to")
    return matches.unionByName(by_seq(ranked, ends, [key], "inner").select(*out))


def rank_rows(placed: S.Placed, patterns: dict[str, list[Stage]], key: list[str], tiebreak: str,
              more: dict[str, Column] | None = None) -> DataFrame:
    """The rows of hot keys with their number ``_seq``, and per stage of each pattern how many rows of it came up to each row
    (``<pattern>_<stage>``; ``more``: further flags to count). Stored, as every stage reads them."""
    flags = {f"{name}_{i}": F.coalesce(s.cond, F.lit(False)) for name, stages in patterns.items() for i, s in enumerate(stages)}
    counts = {"_seq": F.lit(1).cast("bigint"), **{n: c.cast("bigint") for n, c in {**flags, **(more or {})}.items()}}
    counted = S.add_totals(placed.with_rows(placed.busy), counts).rows
    upto = S.over_slices(key, F.asc("_own"), "ts", tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # whether the row itself is one is kept beside the count
    is_one = {f"{n}_is": F.col(n) == 1 for n in counts if n != "_seq"}
    return S.stored(S.own(counted.withColumns({**{n: F.sum(n).over(upto) for n in counts}, **is_one})))


def _null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_key{i}"]) for i, k in enumerate(key)])


def by_seq(ranked: DataFrame, found: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Ranked rows with what was found for their numbers (columns ``_key..``, ``_at`` and others)."""
    keys = [f"_key{i}" for i in range(len(key))]
    return ranked.join(found, _null_safe(ranked, found, key) & (ranked["_seq"] == found["_at"]), how).drop(*keys, "_at")


def matches_by_rank(ranked: DataFrame, stages: list[Stage], span: int, key: list[str], tiebreak: str, amount: str,
                    name: str) -> DataFrame:
    """How the matches end that start in ranked rows: ``_key..``, ``_at`` (the starting row's number) and the struct ``name``.

    Worked from the last stage back, as ``add_matches``. A stage's rows are cut into blocks by their rank; a block also holds
    the ``times - 1`` rows after it. The next stage starts with the rank after all that came up to the stage's last row.
    """
    keys = [f"_key{i}" for i in range(len(key))]
    limit, rest = S.hot_key_rows(ranked.sparkSession), None
    for i in range(len(stages) - 1, -1, -1):
        n, rank = stages[i].times, F.col(f"{name}_{i}")
        last = i == len(stages) - 1
        follow = F.lit(None).cast("bigint") if last else F.col(f"{name}_{i + 1}")
        rows = ranked.where(f"{name}_{i}_is").select(
            *[F.col(k).alias(c) for k, c in zip(key, keys)], rank.alias("_rank"), "_seq", F.col("ts").alias("_ts"),
            F.col(amount).cast("double").alias("_amount"),
            F.struct(F.col("ts").alias("ts"), F.col(tiebreak).alias("id"), follow.alias("follow")).alias("_end"))
        if n > 1:
            size = max(limit, n)
            home = F.floor((F.col("_rank") - 1) / size)
            first = F.greatest(F.floor((F.col("_rank") - n) / size), F.lit(0))
            rows = rows.withColumns({"_home": home, "_block": F.explode(F.sequence(first, home))})
            w = Window.partitionBy(*keys, "_block").orderBy("_rank")
            rows = rows.withColumns({"_end": F.lead("_end", n - 1).over(w), "_amount": F.sum("_amount").over(w.rowsBetween(0, n - 1))})
            rows = rows.where((F.col("_home") == F.col("_block")) & F.col("_end").isNotNull())
        rows = rows.where(F.unix_micros("_end.ts") - F.unix_micros("_ts") < span)
        if last:
            done = rows.withColumn("_to", F.struct(F.col("_end.ts").alias("ts"), F.col("_end.id").alias("id"), F.array("_amount").alias("totals")))
        else:
            ahead = rest.select(*[F.col(c).alias(f"{c}b") for c in keys], F.col("_rank").alias("_next"), F.col("_to").alias("_rest"))
            met = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(ahead[f"{c}b"]) for c in keys])
            done = rows.join(ahead, met & (F.col("_end.follow") + 1 == F.col("_next"))).withColumn("_to", F.struct(
                F.col("_rest.ts").alias("ts"), F.col("_rest.id").alias("id"), F.concat(F.array("_amount"), F.col("_rest.totals")).alias("totals")))
        rest = done.where(F.unix_micros("_to.ts") - F.unix_micros("_ts") < span).select(*keys, "_rank", "_seq", "_to")
    return rest.select(*keys, F.col("_seq").alias("_at"), F.col("_to").alias(name))


def add_matches(sliced: DataFrame, stages: list[Stage], span: int, key: list[str], tiebreak: str, amount: str,
                name: str) -> DataFrame:
    """Adds to rows in slices, where they start a match, how it ends: struct (ts, id, totals), else null.

    Worked from the last stage back. ``_to`` of a row is how its stage onwards completes when the row is the
    stage's first: the stage's last row is ``times - 1`` rows further among rows of that stage, and from there the
    next row of the following stage continues. Both are window lookups in the slice, so no row pairs are formed.
    """
    kept = sliced.columns
    work = sliced.withColumns({f"_is{i}": F.coalesce(s.cond, F.lit(False)) for i, s in enumerate(stages)})
    backward = S.over_slices(key, F.desc("ts"), F.desc(tiebreak)).rowsBetween(Window.unboundedPreceding, -1)
    end = F.struct(F.col("ts").alias("ts"), F.col(tiebreak).alias("id"), F.array().cast("array<double>").alias("totals"))
    for i in range(len(stages) - 1, -1, -1):
        n, flag = stages[i].times, f"_is{i}"
        mine = S.over_slices(key, "ts", tiebreak, more=[flag])
        if i == len(stages) - 1:
            work = work.withColumn("_rest", end)
        else:
            work = work.withColumn("_rest", F.last(F.when(F.col(f"_is{i + 1}"), F.col("_to")), ignorenulls=True).over(backward))
        work = work.withColumns({
            "_there": F.lead("_rest", n - 1).over(mine) if n > 1 else F.col("_rest"),
            "_total": F.sum(amount).over(mine.rowsBetween(0, n - 1)) if n > 1 else F.col(amount).cast("double")})
        work = work.withColumn("_to", F.when(F.col(flag) & F.col("_there").isNotNull(), F.struct(
            F.col("_there.ts").alias("ts"), F.col("_there.id").alias("id"),
            F.concat(F.array("_total"), F.col("_there.totals")).alias("totals"))))
    in_time = F.unix_micros("_to.ts") - F.unix_micros("ts") < span
    return work.select(*kept, F.when(in_time, F.col("_to")).alias(name))


def velocity_stages(n: int = 5, success: tuple[str, ...] = ("completed",)) -> list[Stage]:
    return [Stage("all", F.col("status").isin(*success), n)]


def structuring_stages(high: float = 1000, low: float = 100, n: int = 3,
                       success: tuple[str, ...] = ("completed",)) -> list[Stage]:
    done = F.col("status").isin(*success)
    return [Stage("high", done & (F.col("amount") >= high)), Stage("small", done & (F.col("amount") <= low), n)]


def card_testing_stages(n: int = 3, success: tuple[str, ...] = ("completed",),
                        failure: tuple[str, ...] = ("failed",)) -> list[Stage]:
    return [Stage("failed", F.col("status").isin(*failure), n), Stage("success", F.col("status").isin(*success))]


def velocity(tx: DataFrame, n: int = 5, within: str = "2 minutes", success: tuple[str, ...] = ("completed",)) -> DataFrame:
    """``n`` successful transactions of a user; the amount is their total."""
    return sequence(tx, velocity_stages(n, success), within, "userId", "transactionId")


def structuring(tx: DataFrame, high: float = 1000, low: float = 100, n: int = 3, within: str = "10 minutes",
                success: tuple[str, ...] = ("completed",)) -> DataFrame:
    """A large successful transaction followed by ``n`` small ones."""
    return sequence(tx, structuring_stages(high, low, n, success), within, "userId", "transactionId")


def card_testing(tx: DataFrame, n: int = 3, within: str = "5 minutes", success: tuple[str, ...] = ("completed",),
                 failure: tuple[str, ...] = ("failed",)) -> DataFrame:
    """``n`` failed transactions of a user followed by a successful one."""
    return sequence(tx, card_testing_stages(n, success, failure), within, "userId", "transactionId")


def country_change(tx: DataFrame, within: str = "5 minutes", success: tuple[str, ...] = ("completed",)) -> DataFrame:
    """Two successive successful transactions of a user in different countries."""
    span = micros(within)
    done = tx.where(F.col("status").isin(*success) & F.col("country").isNotNull())
    placed = S.add_later(S.place(done, ["userId"], F.unix_micros("ts")), ["ts", "transactionId"])
    following = F.lead(F.struct("ts", "country", F.col("transactionId").alias("id"))).over(
        S.over_slices(["userId"], "ts", "transactionId"))
    seen = S.own(placed.rows.withColumn("_next", following))
    in_time = F.unix_micros("_next.ts") - F.unix_micros("ts") < span
    return (seen.where(in_time & (F.col("_next.country") != F.col("country")))
            .withColumns({"nextCountry": F.col("_next.country"), "endTs": F.col("_next.ts"), "endId": F.col("_next.id")})
            .drop("_next"))


def off_hours(tx: DataFrame, risk: float = 0.7, tz: str = "UTC", success: tuple[str, ...] = ("completed",)) -> DataFrame:
    """Successful transactions of high risk during the night."""
    return tx.where(is_off_hours(F.col("ts"), tz) & (F.col("riskScore") >= risk) & F.col("status").isin(*success))
