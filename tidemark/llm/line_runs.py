"""Repeated lines: a line found in many documents goes from all of them.

Line keys (white space stripped at both ends, A to Z in lower case) stand as 128-bit hashes. How many documents hold a key is
kept in levelled sorted runs: every batch of documents adds one run of (hash, documents) to level 0; ``FANOUT`` runs of a
level are merged into one of the next. A key whose sum in a merge reaches ``least`` moves to the settled runs, which are
levelled alike. The lines of a new batch are first merge-anti-joined with the settled runs, since a settled key needs no more
counting; what is left is the batch's own run. The runs are parts of a table bucketed by hash, a run a sorted file of each
bucket, so merges, anti-joins and the final sums read buckets side by side and shuffle nothing: a batch costs one shuffle of
its own line counts, combined in the map tasks, and a key is rewritten once a level.

Lines are dropped by a second pass over the texts: their hashes meet the frequent keys in a join (Spark broadcasts these where
it measures them as small and splits hot keys otherwise), the places found are gathered by text, once for equal texts, and
each text is put together from the other places. Texts are shuffled once.

Built-in functions alone. Defined results: a null or empty text is one empty line; lines without a key (white space only) always
stay; every row counts as a document, rows with equal ids or without one included; a key counts once per document; a text all
of whose lines go becomes empty; null stays null. Other columns pass through; ``text`` and ``n_chars`` are renewed where
present, ``n_lines`` and ``n_dropped`` are added or replaced. Two keys of one hash are taken as equal (2^-128 a pair).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, shared_folder, stored, whole

#: Documents that make a line frequent, and runs of a level that are merged into one.
LEAST, FANOUT = 10, 4
BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def line_places(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """A row per line with a key: the kept columns, ``place`` (from 0), ``h1`` and ``h2``."""
    # the kept columns first: beside the explode they would be computed for every line
    ready = docs.select(*keep, lines_of(whole()).alias("_lines"))
    kept = ready.columns[:-1]
    keyed = ready.select(*kept, F.posexplode("_lines").alias("place", "line")).withColumn("key", key_of(F.col("line")))
    return keyed.where("key <> ''").select(*kept, "place", *_hashes(F.col("key")))


class LineRuns:
    """Document counts of line keys over all batches added so far.

    All runs are parts of one bucketed table: Spark 4.1 loses rows where it sums over a union of bucketed tables.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT, buckets: int | None = None):
        if least < 1 or fanout < 2:
            raise ValueError("least must be 1 or more, fanout 2 or more")
        self.spark, self.least, self.fanout, self.buckets = spark, least, fanout, buckets or partitions(spark)
        self.table = f"line_runs_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.table}"
        #: Per kind and level the part that holds its runs, and their number.
        self.counts: list[tuple[str, int]] = []
        self.settled: list[tuple[str, int]] = []
        self.batches: set = set()
        self.parts = 0
        self._write(spark.createDataFrame([], "h1 long, h2 long, docs long"), "none")

    def _write(self, rows: DataFrame, part: str) -> None:
        writer = rows.select(*_HASH, "docs", F.lit(part).alias("part")).write.format("parquet").mode("append")
        writer = writer.partitionBy("part").bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", self.path)
        writer.saveAsTable(self.table)

    def _add(self, levels: list[tuple[str, int]], rows: DataFrame, level: int) -> None:
        if level == len(levels):
            levels.append(("", 0))
        part, runs = levels[level]
        if not runs:
            part, self.parts = f"part{self.parts}", self.parts + 1
        self._write(rows, part)
        levels[level] = part, runs + 1

    def rows(self, levels: list[tuple[str, int]]) -> DataFrame:
        """The rows of all runs of some levels: ``h1``, ``h2``, ``docs``; read by bucket."""
        parts = [part for part, runs in levels if runs]
        return self.spark.table(self.table).where(F.col("part").isin(parts)).select(*_HASH, "docs")

    def sums(self, levels: list[tuple[str, int]]) -> DataFrame:
        return self.rows(levels).groupBy(*_HASH).agg(F.sum("docs").alias("docs"))

    def add(self, batch: DataFrame, name=None) -> None:
        """Adds the lines of a batch of documents with a column ``text``. A batch of a known name is not added again."""
        if name is not None and name in self.batches:
            return
        # strings are told apart by a hash set, structs would be compared in pairs
        keys = F.array_distinct(F.transform(lines_of(whole()), key_of))
        once = batch.select(F.explode(keys).alias("key")).where("key <> ''").select(*_hashes(F.col("key")))
        fresh = once.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("docs"))
        if self.settled:
            # both sides lie in the same buckets, sorted
            fresh = fresh.join(self.rows(self.settled).hint("merge"), _HASH, "left_anti")
        self._add(self.counts, fresh, 0)
        self._compact()
        self.batches.add(name)

    def _compact(self) -> None:
        level = 0
        while level < len(self.counts):
            if self.counts[level][1] >= self.fanout:
                merged = self.sums([self.counts[level]])
                self._add(self.settled, merged.where(F.col("docs") >= self.least), 0)
                self._add(self.counts, merged.where(F.col("docs") < self.least), level + 1)
                self.counts[level] = "", 0
            level += 1
        level = 0
        while level < len(self.settled):
            if self.settled[level][1] >= self.fanout:
                # a key settled at two levels of counts has two rows
                self._add(self.settled, self.sums([self.settled[level]]), level + 1)
                self.settled[level] = "", 0
            level += 1

    def frequent(self) -> DataFrame:
        """Hashes of all keys that ``least`` documents hold: columns ``h1``, ``h2``."""
        return self.sums(self.counts + self.settled).where(F.col("docs") >= self.least).select(*_HASH)


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose places are not in the array ``gone``, in linear time."""

    def others(row: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(row["lines"]) - 1), row["gone"])
        return F.transform(left, lambda i: row["lines"][i])

    # an array step names the lines once; in place they would be split anew for every line that stays
    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), others), 1)


def drop_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` without the lines whose hashes are in ``frequent``."""
    own = [F.xxhash64(whole()).alias("_t1"), F.xxhash64(F.lit(1), whole()).alias("_t2")]
    found = line_places(docs.select("text"), *own).join(frequent, _HASH, "left_semi")
    places = found.groupBy("_t1", "_t2").agg(F.collect_set("place").alias("_gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, *own).join(places, ["_t1", "_t2"], "left")
    lines = lines_of(F.coalesce(F.col("_row.text"), F.lit("")))
    kept = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(_without(lines, F.col("_gone")), "\n"))
    done = keyed.select("_row", kept.alias("_text"), F.size(lines).cast("long").alias("n_lines"),
                        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
    renewed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*[(renewed[c] if c in renewed else F.col(f"_row.`{c}`")).alias(c) for c in names], "n_lines", "n_dropped")


def batches_of(docs: DataFrame, most: int) -> list[DataFrame]:
    """A table of files as at most ``most`` batches of files; each file is in one."""
    files = sorted(docs.inputFiles())
    step = -(-len(files) // most) or 1
    reader = docs.sparkSession.read.schema(docs.schema)
    return [reader.parquet(*files[i:i + step]) for i in range(0, len(files), step)]


def remove_frequent(docs: DataFrame, batches: Iterable[DataFrame] | None = None, least: int = LEAST,
                    fanout: int = FANOUT) -> DataFrame:
    """``docs`` without the lines that ``least`` of its documents hold; ``batches`` are all its rows, in parts (one part if not given)."""
    runs = LineRuns(docs.sparkSession, least, fanout)
    for batch in batches or [docs]:
        runs.add(batch.select("text"))
    return drop_lines(docs, stored(runs.frequent()))
