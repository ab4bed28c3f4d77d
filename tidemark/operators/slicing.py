"""Ordered per-key work without putting a hot key into one task.

A window over ``key`` alone sends every row of a key to one task, which fails when one key holds a third of a
large table. ``place`` counts rows per key in one scan of the key and the position alone. Where no key has more than
``HOT_KEY_ROWS`` rows the plan stays the plain window: one more scan, one shuffle, nothing stored, no copies.

Otherwise the second scan writes every row once to the shared folder, hot keys apart from the others, and all that
follows reads that copy. Hot keys are cut along the order column into slices of about the limit, as narrow as the densest
part of the key asks for; windows run over ``(key, _slice)``, all other keys lying whole in slice 0. What a slice needs
from others is a two-level scan: each slice is summed up (its first and last row, its totals), the summaries, fewer than
(rows / limit) times a small number, are stored and scanned along the key, and each slice gets the outcome as a *halo* row
(``_own`` is false), which takes part in the window and is dropped afterwards:

* nearest earlier or later row, however far: ``add_earlier``, ``add_later`` and ``add_neighbours``; the first of all: ``add_past``;
* running totals: ``add_totals``;
* bounded reach (``before``/``after``): rows near an edge are copied;
* the last n rows: ``last_rows`` puts every window together from two sums over blocks of n numbered rows.

So the source is read twice, with hot keys or without, whatever the operator carries.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder

HOT_KEY_ROWS = 2_000_000
HOT_KEY_SETTING = "tidemark.hotKeyRows"
CELLS = 4096


def hot_key_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_KEY_SETTING, str(HOT_KEY_ROWS)))


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: it survives lost executors and is computed once."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(df: DataFrame, other: DataFrame, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"_key{i}"]) for i, k in enumerate(key)])


def _renamed(key: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]


@dataclass(frozen=True)
class Placed:
    """Rows with ``_slice``, ``_own`` and ``_hot``; those of hot keys alone, read from the stored copy (None without such keys);
    and the largest position of all (None without rows)."""

    rows: DataFrame
    busy: DataFrame | None
    key: list[str]
    newest: int | None

    def with_rows(self, rows: DataFrame) -> Placed:
        return replace(self, rows=rows)


def place(df: DataFrame, key: list[str], pos: Column, before: int = 0, after: int = 0) -> Placed:
    """Places rows by key and slice; copies rows into slices that reach back ``before`` or ahead ``after``.

    Rows without a position have no place in the order and are left out. The count runs at once."""
    df, limit = df.where(pos.isNotNull()), hot_key_rows(df.sparkSession)
    seen = Observation()
    narrow = df.select(*_renamed(key), pos.alias("_p")).observe(seen, F.max("_p").alias("newest"))
    names = [f"_key{i}" for i in range(len(key))]
    counted = narrow.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    crowded = stored(counted.where(F.col("_n") > limit).select(
        *names, "_lo", F.ceil((F.col("_hi") - F.col("_lo") + 1) / CELLS).alias("_cell")))
    newest = seen.get["newest"]
    if crowded.isEmpty():
        plain = df.select("*", F.lit(0).cast("bigint").alias("_slice"), F.lit(True).alias("_own"), F.lit(False).alias("_hot"))
        return Placed(plain, None, key, newest)
    marked = df.join(crowded, _same(df, crowded, key), "left").select(
        *[df[c] for c in df.columns], pos.alias("_pos"), "_lo", "_cell", F.col("_cell").isNotNull().alias("_hot"))
    copy = stored(marked, "_hot")
    quiet = copy.where(~F.col("_hot")).select(
        *df.columns, F.lit(0).cast("bigint").alias("_slice"), F.lit(True).alias("_own"), F.lit(False).alias("_hot"))
    mine = copy.where("_hot")
    cells = mine.groupBy(*_renamed(key), "_lo", "_cell", F.floor((F.col("_pos") - F.col("_lo")) / F.col("_cell")).alias("_at"))
    densest = cells.agg(F.count(F.lit(1)).alias("_n")).groupBy(*names, "_cell").agg(F.max("_n").alias("_n"))
    width = F.when(F.col("_n") > limit, F.ceil(F.col("_cell") / F.ceil(F.col("_n") / limit))).otherwise(
        F.col("_cell") * F.floor(limit / F.col("_n")))
    widths = stored(densest.select(*names, F.greatest(width, F.lit(max(before, after, 1))).alias("_width")))

    def at(p: Column) -> Column:
        return F.floor((p - F.col("_lo")) / F.col("_width"))

    sized = mine.join(widths, _same(mine, widths, key)).withColumn("_slice", at(F.col("_pos")))
    if before or after:
        reach = F.sequence(F.greatest(at(F.col("_pos") - after), F.lit(0)), at(F.col("_pos") + before))
        sized = sized.withColumnRenamed("_slice", "_home").withColumn("_slice", F.explode(reach))
        sized = sized.withColumn("_own", F.col("_home") == F.col("_slice"))
    else:
        sized = sized.withColumn("_own", F.lit(True))
    busy = sized.select(*df.columns, "_slice", "_own", F.lit(True).alias("_hot"))
    return Placed(quiet.unionByName(busy), busy, key, newest)


def slice_rows(df: DataFrame, key: list[str], pos: Column, before: int = 0, after: int = 0) -> DataFrame:
    """The rows of ``place``."""
    return place(df, key, pos, before, after).rows


def over_slices(key: list[str], *order: Column | str, more: list[str] | None = None):
    """The window over a key's slice; ``more`` splits it further and needs no further shuffle."""
    return Window.partitionBy(*key, "_slice", *(more or [])).orderBy(*order)


def by_slice(placed: Placed) -> DataFrame:
    """Rows moved by slice once, for several windows to come: the first of them alone might place them more finely,
    and the next would have to move them again."""
    return placed.rows.repartition(*placed.key, *([] if placed.busy is None else ["_slice"]))


def own(df: DataFrame) -> DataFrame:
    """Drops halo rows and the helper columns."""
    return df.where("_own").drop("_own", "_slice", "_hot")


def _carried(placed: Placed, order: list[str], cond: Column | None, wanted: tuple[str, ...]) -> Placed:
    """Halo rows: the ``last`` of the slices before, the ``next`` of those after, the very ``first`` of the key."""
    if placed.busy is None:
        return placed
    key, columns = placed.key, [c for c in placed.busy.columns if c not in ("_slice", "_own", "_hot")]
    row, rank = F.struct(*columns), F.struct(*order)
    if cond is not None:
        row, rank = F.when(cond, row), F.when(cond, rank)
    edges = stored(placed.busy.where("_own").groupBy(*key, "_slice").agg(
        F.max_by(row, rank).alias("_last"), F.min_by(row, rank).alias("_first")))
    rows = placed.rows
    taken = {"last": F.last("_last", ignorenulls=True), "next": F.last("_first", ignorenulls=True),
             "first": F.first("_first", ignorenulls=True)}
    for which in wanted:
        steps = Window.partitionBy(*key).orderBy(F.desc("_slice") if which == "next" else F.asc("_slice"))
        edge = taken[which].over(steps.rowsBetween(Window.unboundedPreceding, -1))
        halo = edges.select("_slice", edge.alias("_edge")).where(F.col("_edge").isNotNull())
        rows = rows.unionByName(halo.select(*[F.col("_edge")[c].alias(c) for c in columns], "_slice",
                                            F.lit(False).alias("_own"), F.lit(True).alias("_hot")), allowMissingColumns=True)
    return placed.with_rows(rows)


def add_earlier(placed: Placed, order: list[str], cond: Column | None = None) -> Placed:
    """Gives each slice of a hot key the last row (that meets ``cond``) of all its earlier slices."""
    return _carried(placed, order, cond, ("last",))


def add_later(placed: Placed, order: list[str], cond: Column | None = None) -> Placed:
    """Gives each slice of a hot key the first row (that meets ``cond``) of all its later slices."""
    return _carried(placed, order, cond, ("next",))


def add_neighbours(placed: Placed, order: list[str]) -> Placed:
    """Gives each slice of a hot key the last row before it and the first row after it."""
    return _carried(placed, order, None, ("last", "next"))


def add_past(placed: Placed, order: list[str]) -> Placed:
    """Gives each slice of a hot key the first row of the key and the last row before the slice."""
    return _carried(placed, order, None, ("first", "last"))


def add_totals(placed: Placed, totals: dict[str, Column], more: tuple[str, ...] = ()) -> Placed:
    """Adds the columns ``totals``, which are zero on halo rows, and carries their sums over earlier slices, for each
    value of the columns ``more``.

    A running sum over ``(key, _slice, more)`` that starts with the carried row (``_own`` false, all else null) is then
    the running sum over the whole key.
    """
    plain = placed.rows.withColumns({n: F.when(F.col("_own"), v).otherwise(0) for n, v in totals.items()})
    if placed.busy is None:
        return placed.with_rows(plain)
    key = [*placed.key, *more]
    sums = placed.busy.where("_own").groupBy(*key, "_slice").agg(*[F.sum(v).alias(n) for n, v in totals.items()])
    slices = stored(sums)
    steps = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*key, "_slice", *[F.sum(n).over(steps).alias(n) for n in totals])
    carried = carried.where(F.col(next(iter(totals))).isNotNull()).select(
        *key, "_slice", *[F.col(n).cast(plain.schema[n].dataType).alias(n) for n in totals],
        F.lit(False).alias("_own"), F.lit(True).alias("_hot"))
    return placed.with_rows(plain.unionByName(carried, allowMissingColumns=True))


def with_leavings(sliced: DataFrame, span: int) -> DataFrame:
    """Every row twice: as it comes at ``_p``, and as it leaves a trailing window of ``span`` (``_leaves``).

    ``_at`` is the time of either. Ordered by (``_at``, ``_leaves``), a row leaves after all that comes at the same
    time, so a window includes its older end."""
    both = F.array(F.struct(F.col("_p").alias("at"), F.lit(False).alias("leaves")),
                   F.struct((F.col("_p") + span).alias("at"), F.lit(True).alias("leaves")))
    twice = sliced.withColumn("_move", F.explode(both))
    return twice.withColumns({"_at": F.col("_move.at"), "_leaves": F.col("_move.leaves")}).drop("_move")


def _numbered(placed: Placed, order: list[str], name: str) -> DataFrame:
    counted = add_totals(placed, {"_one": F.lit(1).cast("bigint")})
    running = earliest_first(placed.key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.rows.withColumn(name, F.sum("_one").over(running)).drop("_one")


def numbered(placed: Placed, order: list[str], name: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """Own rows with their number within the key, from 1, and ``columns``, which take halo rows of ``placed`` into account:
    expressions over ``earliest_first``."""
    return own(_numbered(placed, order, name).withColumns(columns or {}))


def earliest_first(key: list[str], order: list[str]):
    """The window over a key's slice with rows of other slices ahead."""
    return over_slices(key, F.asc("_own"), *order)


def row_numbers(df: DataFrame, key: list[str], pos: Column, order: list[str], name: str) -> DataFrame:
    """Row number within the key, counted from 1."""
    return numbered(place(df, key, pos), order, name)


def _moments(rows: DataFrame, key: list[str], value: str, n: int) -> DataFrame:
    """Rows with ``_head`` and ``_tail``: moments of their block of n numbered rows up to this row, and from it on. The origin of
    either (``o``) is its first value, so it lies in every window that is put together from it."""
    known = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    block = Window.partitionBy(*key, "_block")
    rows = rows.withColumn("_block", F.floor((F.col("_no") - 1) / n))
    for name, by in (("_head", F.asc("_no")), ("_tail", F.desc("_no"))):
        over = block.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_o", F.coalesce(F.first(known, ignorenulls=True).over(over), F.lit(0.0)))
        away = F.col(value) - F.col("_o")
        rows = rows.withColumn(name, F.struct(
            F.count(away).over(over).alias("n"), F.avg(away).over(over).alias("m"), F.var_pop(away).over(over).alias("v"),
            F.min(value).over(over).alias("low"), F.max(value).over(over).alias("high"), F.col("_o").alias("o")))
    return rows.drop("_o", "_block")


def last_rows(placed: Placed, order: list[str], value: str, n: int) -> DataFrame:
    """Own rows with the number ``_n``, ``_mean`` and population deviation ``_std`` of the last ``n`` rows, this one included,
    the distance ``_off`` from the mean, and ``_prev``, the row before (``order`` columns and ``value``).

    Rows of a key are numbered and cut into blocks of ``n``. The last n rows up to a row are the head of its own block and a
    tail of the block before; both are running moments that start anew with each block, so a row costs the same
    whatever ``n`` is, and nothing is subtracted that was added before. For a hot key the tail finds its row by
    (key, number): no row is copied, and no task needs more than a block in order. Moments are taken about a value of the
    window, so a large common offset costs no digits: the error of mean and deviation is some n * 2 ** -53 of the range of
    the window's values. Equal values have the deviation 0. Missing values count as rows only.
    """
    key, before = placed.key, F.struct(*order, value)
    w = over_slices(key, *order)
    quiet = placed.rows if placed.busy is None else placed.rows.where("NOT _hot")
    quiet = quiet.withColumns({"_no": F.row_number().over(w), "_prev": F.lag(before).over(w)})
    quiet = _moments(quiet, [*key, "_slice"], value, n)
    # A window that fills its block needs no tail.
    rest = F.when(F.col("_no") % n != 0, F.lag("_tail", n - 1).over(over_slices(key, "_no")))
    done = own(quiet.withColumn("_rest", rest)).drop("_tail")
    if placed.busy is not None:
        near = add_earlier(placed.with_rows(placed.busy), order)
        rows = numbered(near, order, "_no", {"_prev": F.lag(before).over(earliest_first(key, order))})
        summed = stored(_moments(rows, key, value, n))
        tails = summed.where(F.col("_no") % n != 1 % n).select(*_renamed(key), (F.col("_no") + n - 1).alias("_at"), F.col("_tail").alias("_rest"))
        met = summed.join(tails, _same(summed, tails, key) & (summed["_no"] == tails["_at"]), "left")
        done = done.unionByName(met.select(*done.columns))
    a, b = F.col("_head.n").cast("double"), F.coalesce(F.col("_rest.n"), F.lit(0)).cast("double")
    # The tail's mean as seen from the head's origin; a side without values takes the other's.
    other = (F.col("_rest.o") - F.col("_head.o")) + F.col("_rest.m")
    one, two = F.coalesce(F.col("_head.m"), other), F.coalesce(other, F.col("_head.m"))
    mean = F.try_divide(a * one + b * two, a + b)
    spread = (a * F.coalesce(F.col("_head.v"), F.lit(0.0)) + b * F.coalesce(F.col("_rest.v"), F.lit(0.0))
              + F.try_divide(a * b, a + b) * (one - two) * (one - two))
    low, high = F.least("_head.low", "_rest.low"), F.greatest("_head.high", "_rest.high")
    std = F.when((low == high) & ~F.isnan(low), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(spread, a + b)))
    return done.withColumns({
        "_n": F.least(F.col("_no"), F.lit(n)).cast("bigint"), "_mean": F.col("_head.o") + mean, "_std": std,
        "_off": F.abs(F.col(value) - F.col("_head.o") - mean)}).drop("_no", "_head", "_rest")
