"""Exact join of texts whose sets of word shingles overlap: Jaccard similarity of 0.75 or more by default.

Documents with equal sets form a class, which takes part once. Sizes fall into bands so wide that linked sets lie in one
band or in two adjacent ones. Every class has a bitmap of its shingles by hash (the parity of each bit); the bits in which
two bitmaps differ bound the overlap from above. What passes is verified by intersecting the sorted arrays.

Pairs come from shared prefix shingles: of n shingles in a global order, the first n - ceil(0.75 n) + 1 of two linked sets
have one in common, whatever the order. It is the order of hashes, but for the shingles that most sets share, which go
last: so a passage in many documents makes no pairs. All keys are counted for that; those held by one set only are left
out. A tile holds the classes of one key and one size band. First every class is compared with one tile leader, and
verified links make components. Then pairs of one key, in the same or adjacent bands, are compared unless they are already
in one component. So dense groups of near copies cost one comparison per member, and no link between components is missed.

Sets and classes are held as 64-bit hashes: among a billion different ones the chance of any collision is 3 %.

Defined results: null and empty texts have no shingles and stand alone, each its own component; a text with fewer words
than a shingle is one shingle; rows with equal ids and texts are one vertex; documents of one class share a component,
whose name is its smallest doc_id (rows without an id do not name it); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bitmaps
from tidemark.llm.common import components, slices, stored, unpacked, whole
from tidemark.llm.shingles import sets as sets_of

#: Least similarity, in hundredths.
LEAST = 75
#: Keys of more classes than this go last in the order, most frequent first, up to a number that fits every task.
OFTEN, MOST_HOT = 32, 200_000
WORDS = 16  # least number of 64-bit words of a bitmap


def needed(n: np.ndarray | int, least: int):
    """Least overlap of a set of n with any set linked to it."""
    return -(-least * n // 100)


def prefix(shingles: np.ndarray, least: int, late: np.ndarray | None = None) -> np.ndarray:
    """The first shingles in the order (hot ones last, then by hash)."""
    take = len(shingles) - needed(len(shingles), least) + 1
    if late is not None:
        shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[:take]


def members(values: np.ndarray, of: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``; ``bits`` is its ``marks``."""
    out = bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        out[at] = of[np.minimum(np.searchsorted(of, values[at]), len(of) - 1)] == values[at]
    return out


def marks(of: np.ndarray) -> np.ndarray:
    """Where members can be, by the low bits of a hash."""
    out = np.zeros(1 << max(16, (16 * len(of)).bit_length()), bool)
    out[(of & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Twice as many bits as shingles or more, a power of 2. Its halves, added, are the bitmap of half the size."""
    size = max(64 * WORDS, 1 << (2 * len(shingles) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def thrice(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that three sets or more hold, and how many do. Empties the list, so that it and one copy are all that is held."""
    every = np.concatenate(sets)
    sets.clear()
    every.sort()
    keys = np.unique(every[2:][every[2:] == every[:-2]])
    return keys, np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left")


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Prefix keys of every class of the task, and any shingles that many classes of the task hold, with their number.

    The latter may be in no prefix by hash, but would enter the prefixes that other frequent shingles leave."""
    seen, none = set(), np.array([], np.uint64)
    held, size = [none], 0

    def rows(keys: np.ndarray, sets: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets, pa.int32()), pa.array(often, pa.int32())],
                                          ["key", "sets", "often"])

    def frequent() -> pa.RecordBatch:
        keys, many = thrice(held)
        return rows(keys, np.zeros(len(keys), np.int32), many.astype(np.int32))

    for batch in slices(batches):
        found = [none]
        for shingles in sets_of(batch.column("text")):
            own = class_of(shingles)
            if len(shingles) and own not in seen:
                seen.add(own)
                found.append(prefix(shingles, least))
                held.append(shingles.copy())
                size += len(shingles)
        keys = np.concatenate(found)
        yield rows(keys, np.ones(len(keys), np.int32), np.zeros(len(keys), np.int32))
        if size > 4_000_000:
            yield frequent()
            held, size = [none], 0
    yield frequent()


_PROFILE = "doc_id long, source long, n long, class long, band int, hot int, late boolean, keys array<long>, bits array<long>"


def _profiles(batches: Iterator[pa.RecordBatch], least: int, hot) -> Iterator[pa.RecordBatch]:
    seen, often, bits_of = set(), hot.value, marks(hot.value)
    for batch in slices(batches):
        rows = []
        for shingles in sets_of(batch.column("text")):
            n, own = len(shingles), class_of(shingles)
            many, late, keys, bits = 0, False, None, None
            if n and own not in seen:
                seen.add(own)
                famous = members(shingles, often, bits_of)
                many = int(famous.sum())
                keys = prefix(shingles, least)
                late = bool(famous[:len(keys)].any())
                keys, bits = (prefix(shingles, least, famous) if late else keys).view(np.int64), bitmap(shingles)
            rows.append((n, own, band(n, least), many, late, keys, bits))
        columns = list(zip(*rows)) if rows else [()] * 7
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), longs, longs]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "source", "n", "class", "band", "hot", "late", "keys", "bits"])


def band(n: int, least: int) -> int:
    """Bands are as wide as linked sizes may differ."""
    return int(math.log(n) / math.log(100 / least)) if n else 0


def profiles(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Per document the hash of its text, its class, set size and band, and once per task and class its hot shingles' number, prefix keys and
    bitmap; the filter of the keys that several sets may hold; and the hot keys."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("source"), whole().alias("text"))
    counted = (texts.select("text").mapInArrow(partial(_keys, least=least), "key long, sets int, often int").groupBy("key")
               .agg(F.sum("sets").alias("sets"), F.sum("often").alias("often")).where((F.col("sets") > 1) | (F.col("often") > OFTEN)))
    counted = stored(counted.select("sets", "key", F.greatest("sets", "often").alias("most")))
    often = counted.where(F.col("most") > OFTEN).orderBy(F.desc("most"), "key").limit(MOST_HOT).select("key").collect()
    hot = np.sort(np.array([r.key for r in often], dtype=np.int64).view(np.uint64))
    made = stored(texts.mapInArrow(partial(_profiles, least=least, hot=spark.sparkContext.broadcast(hot)), _PROFILE))
    shared = bitmaps.of_column(counted.where("sets > 1"), "key")
    if len(hot):  # keys that sets took in place of hot ones were not counted
        shared = shared | bitmaps.of_column(made.where("late").select(F.explode("keys").alias("key")), "key")
    return made, shared, hot


def _key_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for each key that passes the filter. ``onward``: the set's shingles from this key on, in the order of all.

    Two sets have nothing in common before their first common key, so the smaller of their ``onward`` there bounds the
    overlap."""
    names = ["band", "hot", "n", "class"]
    for batch in slices(batches):
        keys = batch.column("keys")
        flat = keys.flatten().to_numpy()
        size = np.diff(keys.offsets.to_numpy())
        owner = np.repeat(np.arange(len(keys)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        hit = bitmaps.holds(shared.value, flat)
        at = pa.array(owner[hit])
        onward = batch.column("n").to_numpy()[owner[hit]] - place[hit]
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat[hit]), *(batch.column(c).take(at) for c in names), pa.array(onward)], ["key", *names, "onward"])


def tiles(profiled: DataFrame, shared: np.ndarray) -> DataFrame:
    """Rows (key, band, n, class, onward, leader) of the keys that several classes hold.

    The leader of a tile is the class with the largest share of hot shingles: in a crowd of near copies that is the one
    nearest to all others."""
    lend = profiled.sparkSession.sparkContext.broadcast
    rows = profiled.where("keys is not null").select("keys", "band", "hot", "n", "class").mapInArrow(
        partial(_key_rows, shared=lend(shared)), "key long, band int, hot int, n long, class long, onward long")
    order = [F.desc(F.col("hot") / F.col("n")), "n", "class"]
    by_key = Window.partitionBy("key").orderBy("band", *order)
    once = rows.withColumn("_before", F.lag("class").over(by_key)).where("_before is null or _before <> class").drop("_before")
    near = once.withColumns({"_before": F.lag("class").over(by_key), "_after": F.lead("class").over(by_key)})
    in_tile = Window.partitionBy("key", "band").orderBy(*order)
    return (near.where("_before is not null or _after is not null").drop("_before", "_after")
            .withColumn("leader", F.first(F.struct("class", "n", "onward")).over(in_tile)).drop("hot"))


def _near(a: str, b: str, least: int) -> Column:
    """At their first common key two sets have shingles enough left for a link."""
    n, m, rest = F.col(f"{a}n"), F.col(f"{b}n"), F.least(F.col(f"{a}onward"), F.col(f"{b}onward"))
    return rest * (100 + least) >= (n + m) * least


def _overlap_possible(a: str, b: str, least: int) -> Column:
    """Sizes and bitmaps allow the overlap that a link needs: overlap <= (n + m - differing bits) / 2.

    Sets that may be linked by size have bitmaps of one size, or of one and twice that."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.bits"), F.col(f"{b}.bits")
    size = F.least(F.size(p), F.size(q))

    def folded(bits: Column) -> Column:
        halves = F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > size, halves).otherwise(bits)

    apart = F.aggregate(F.zip_with(folded(p), folded(q), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    # 100 * overlap >= least * (n + m - overlap)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * least) & ((n + m - apart) * (100 + least) >= 2 * least * (n + m))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked. Texts of those that bitmaps let through are brought together packed, and
    intersected exactly."""
    a, b = classes.alias("a"), classes.alias("b")
    hopeful = stored(pairs.join(a, F.col("x") == F.col("a.class")).join(b, F.col("y") == F.col("b.class"))
                     .where(_overlap_possible("a", "b", least)).select("x", "y", F.col("a.source").alias("p"), F.col("b.source").alias("q")))
    wanted = hopeful.select(F.col("x").alias("class"), F.col("p").alias("source")).unionAll(hopeful.select("y", "q")).distinct()
    texts = _texts_of(docs, wanted)
    left = texts.select(F.col("class").alias("x"), F.col("text").alias("left"))
    right = texts.select(F.col("class").alias("y"), F.col("text").alias("right"))
    both = hopeful.select("x", "y").join(left, "x").join(right, "y")

    return both.select("x", "y", "left", "right").mapInArrow(partial(_linked, least=least), "a long, b long")


class _Sets(dict):
    """Sets of the classes met last, up to so many shingles (4 MB)."""

    most = 500_000

    def __init__(self):
        self.size = 0

    def of(self, own: int, text: pa.BinaryScalar) -> np.ndarray:
        if own in self:
            return self[own]
        made = sets_of(pa.array([unpacked(text.as_py())], pa.string()))[0]
        self.size += len(made)
        if self.size > self.most:
            self.clear()
            self.size = len(made)
        self[own] = made
        return made


def _linked(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    sets, last = _Sets(), (None, None)
    for batch in slices(batches):
        keep = []
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        for a, b, p, q in zip(x, y, batch.column("left"), batch.column("right")):
            if b != last[0]:  # a leader's rows come together
                last = (b, sets.of(b, q))
            s, t = sets.of(a, p), last[1]
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * common >= least * (len(s) + len(t) - common))
        pairs = pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["a", "b"])
        yield pairs.filter(pa.array(keep, pa.bool_()))


def join(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable by links)."""
    made, shared, hot = profiles(docs, least)
    tile = stored(tiles(made, shared))
    classes = (made.where("keys is not null").groupBy("class")
               .agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("source").alias("source")))
    sizes = stored(classes.join(tile.select("class").distinct(), "class"))

    votes = (tile.where((F.col("leader.class") != F.col("class")) & _near("", "leader.", least))
             .groupBy("class", F.col("leader.class").alias("leader"))
             .agg(F.count("*").alias("keys")))
    best = votes.groupBy("class").agg(F.max(F.struct("keys", "leader"))["leader"].alias("leader"))
    first = stored(verified(best.select(F.col("class").alias("x"), F.col("leader").alias("y")), sizes, docs, least))
    labels = components(first)

    named_tile = (tile.join(labels.withColumnRenamed("v", "class"), "class", "left")
                  .select("key", "band", "n", "class", "onward", F.coalesce("component", "class").alias("component")))
    mixed = (named_tile.groupBy("key").agg(F.mode("component").alias("main"), F.min("component").alias("low"),
                                           F.max("component").alias("high")).where("low <> high").select("key", "main"))
    rest = stored(named_tile.join(mixed, "key"))
    a, b = rest.where("component <> main").alias("a"), rest.alias("b")
    apart = ((F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component"))
             & (F.abs(F.col("a.band") - F.col("b.band")) <= 1) & _near("a.", "b.", least)
             & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * least)
             & ((F.col("b.component") == F.col("b.main")) | (F.col("a.class") < F.col("b.class"))))
    pairs = a.join(b, apart).select(F.least("a.class", "b.class").alias("x"), F.greatest("a.class", "b.class").alias("y")).distinct()
    second = stored(verified(pairs, sizes, docs, least))
    if not second.isEmpty():
        labels = components(first.unionAll(second))

    smallest = made.groupBy("class").agg(F.min("doc_id").alias("smallest"))
    joined = smallest.join(labels.withColumnRenamed("v", "class"), "class", "left").select(
        "class", "smallest", F.coalesce("component", "class").alias("component"))
    of = joined.join(joined.groupBy("component").agg(F.min("smallest").alias("component_id")), "component")
    return made.select("doc_id", "n", "class").join(of.select("class", "component_id"), "class").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _packed(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """Hash and packed text of the texts that may be wanted."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        own = batch.filter(pa.array(bitmaps.holds(wanted.value, batch.column("source").to_numpy(zero_copy_only=False))))
        packed = [press.compress(t.encode()) for t in own.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([own.column("source"), pa.array(packed, pa.binary())], ["source", "text"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, packed text) of every class that is compared. A filter on hashes keeps the other texts out of the shuffle."""
    lent = docs.sparkSession.sparkContext.broadcast(bitmaps.of_column(wanted, "source"))
    made = docs.select(F.xxhash64(whole()).alias("source"), whole().alias("text")).mapInArrow(
        partial(_packed, wanted=lent), "source long, text binary")
    return stored(made.join(wanted, "source").dropDuplicates(["class"]).select("class", "text"))
