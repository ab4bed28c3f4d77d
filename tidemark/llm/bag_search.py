"""Ranked lexical search: the best documents of every item, scored once for all documents that look alike to the items.

1. A text is cut into terms, and what the items' vocabulary does not hold is dropped: left are the number of all its terms and
   its *bag*, the vocabulary's terms in it with how often each occurs. Bags are written once.
2. Number of documents, terms and documents per term are summed over all bags, and give each term its weight and each document
   its length norm m.
3. Documents with equal bags and equal m have equal scores for every item. They are grouped by a hash of both; the grouping
   compares the bytes as well. Of a class only the ``top`` least doc_ids can be among any item's ``top`` documents, so a class
   keeps these: the map tasks already drop the rest.
4. Each class is scored once against the items that share a term with it, over the terms' postings; a task keeps the ``top``
   documents of each item, members of a class in order of doc_id, and the best of all tasks are ranked.

Items go in blocks of at most ``BLOCK_TERMS`` distinct terms (or one item), so what is sent to the tasks is bounded however many
items there are; beyond one block the texts are read once for each, which joins nothing. Statistics are exact whole numbers.

Defined results: a null text has no terms; documents without terms do not count; every row is a document, rows with equal ids
or without one included (those without come last among equals); items without terms, or with a null text, find nothing; items
are rows as well: each row of an item id is ranked, and equal rows once. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, whole

TOP = 20
#: Distinct terms of a block of items: some 100 MB in a task.
BLOCK_TERMS = 300_000
#: Classes scored at a time.
STEP = 256
_LAST = 2**63 - 1
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters, A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Block:
    """Some items' terms: a number for each, and the items that hold it, how often."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for at, (_, text) in enumerate(items):
            for term, times in Counter(terms_of(text)).items():
                number = self.vocabulary.setdefault(term, len(self.vocabulary))
                if number == len(postings):
                    postings.append([])
                postings[number].append((at, times))
        self.starts = np.cumsum([0, *map(len, postings)])
        self.items = np.array([i for p in postings for i, _ in p], np.int64)
        self.times = np.array([n for p in postings for _, n in p], np.int64)

    def bag(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of terms, and the bag: numbers of the terms (4 bytes each, ascending) and their frequencies."""
        terms = terms_of(text)
        known = self.vocabulary.get
        found = np.array([n for n in map(known, terms) if n is not None], np.int64)
        numbers, times = np.unique(found, return_counts=True)
        return len(terms), numbers.astype("<i4").tobytes(), times.astype("<i4").tobytes()


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """Items in blocks of at most ``most`` distinct terms; one item at least. They come through the driver one after another."""
    own, seen = [], set()
    for row in items.select("item_id", whole().alias("text")).distinct().toLocalIterator():
        terms = set(terms_of(row.text))
        if own and len(seen | terms) > most:
            yield Block(own)
            own, seen = [], set()
        own.append((row.item_id, row.text))
        seen |= terms
    if own:
        yield Block(own)


def bags(docs: DataFrame, block: Block) -> DataFrame:
    """``doc_id``, ``n`` (number of terms), ``terms`` and ``times`` (the bag) of every document with a term."""
    lent = docs.sparkSession.sparkContext.broadcast(block)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((b for b in batches), 200):
            rows = [lent.value.bag(text) for text in batch.column("text").to_pylist()]
            n, terms, times = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
                ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n long, terms binary, times binary").where("n > 0")


def holders(bagged: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs; tasks add up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for own in slices([batch], 1000):
                total += np.bincount(np.frombuffer(b"".join(own.column("terms").to_pylist()), "<i4"), minlength=terms)[:terms]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "docs"])

    out = np.zeros(terms, np.int64)
    for row in bagged.select("terms").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[row.term] = row.docs
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def classes(bagged: DataFrame, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """``m``, ``terms``, ``times`` of each class of documents, and its ``top`` least ``doc_ids`` in order."""
    length = F.lit(25) * F.col("n") * F.lit(n_docs)
    normed = bagged.select("doc_id", F.expr("75L").alias("_base"), length.alias("_length"), "terms", "times")
    normed = normed.select("doc_id", (F.col("_base") + F.expr(f"_length div {n_terms}L")).alias("m"), "terms", "times")
    normed = normed.where(F.length("terms") > 0).withColumn("_hash", F.xxhash64("m", "terms", "times"))
    same = ["_hash", "m", "terms", "times"]
    order = Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last())
    least = normed.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= top)
    members = F.array_sort(F.collect_list(F.struct(F.coalesce("doc_id", F.lit(_LAST)), F.col("_no"))))
    # rows of one class are together already
    return least.groupBy(*same).agg(F.transform(members, lambda x: x["col1"]).alias("doc_ids")).drop("_hash")


def _best(scores: np.ndarray, items: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` rows of each item: by score descending, then id."""
    order = np.lexsort((ids, -scores, items))
    own = items[order]
    first = np.searchsorted(own, own, "left")
    return order[np.arange(len(order)) - first < top]


def score_classes(m: np.ndarray, terms: list[bytes], times: list[bytes], block: Block, weight: np.ndarray) -> np.ndarray:
    """Scores of some classes for all items of the block: a matrix."""
    sizes = np.array([len(t) // 4 for t in terms])
    numbers = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
    tf = np.frombuffer(b"".join(times), "<i4").astype(np.int64)
    row = np.repeat(np.arange(len(terms)), sizes)
    share = weight[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    many = block.starts[numbers + 1] - block.starts[numbers]
    # the postings of all terms, one after another
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(block.starts[numbers], many)
    out = np.zeros(len(terms) * len(block.ids), np.int64)
    np.add.at(out, np.repeat(row, many) * len(block.ids) + block.items[at], np.repeat(share, many) * block.times[at])
    return out.reshape(len(terms), len(block.ids))


def best_of_tasks(grouped: DataFrame, block: Block, weight: np.ndarray, top: int = TOP) -> DataFrame:
    """Every task's ``top`` documents of each item: ``item`` (its place in the block), ``doc_id``, ``score``."""
    lent = grouped.sparkSession.sparkContext.broadcast((block, weight))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = lent.value
        kept = [np.zeros(0, np.int64)] * 3
        bar = np.zeros(len(block.ids), np.int64)  # the score that a new document must reach
        step = max(1, min(STEP, 4_000_000 // max(len(block.ids), 1)))
        for batch in slices(batches, step):
            m = batch.column("m").to_numpy()
            scores = score_classes(m, batch.column("terms").to_pylist(), batch.column("times").to_pylist(), block, weight)
            row, item = np.nonzero((scores >= bar) & (scores > 0))
            members = batch.column("doc_ids")
            flat, offsets = members.flatten().to_numpy(), members.offsets.to_numpy()
            offsets = offsets - offsets[0]
            many = np.diff(offsets)[row]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[:-1][row], many)
            more = np.repeat(scores[row, item], many), np.repeat(item, many), flat[at]
            kept = [np.concatenate(x) for x in zip(kept, more)]
            best = _best(*kept, top)
            kept = [x[best] for x in kept]
            full = np.flatnonzero(np.bincount(kept[1], minlength=len(bar)) == top)
            last = np.searchsorted(kept[1], full, "right") - 1
            bar[full] = kept[0][last]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(kept[1]), pa.array(kept[2]), pa.array(kept[0])], ["item", "doc_id", "score"])

    return grouped.mapInArrow(rank, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's best documents."""
    spark, found = docs.sparkSession, []
    kind = items.schema["item_id"].dataType
    for block in blocks(items, most):
        bagged = stored(bags(docs, block))
        sums = bagged.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not sums.docs or not block.vocabulary:
            continue
        weight = weights(holders(bagged, len(block.vocabulary)), sums.docs)
        best = best_of_tasks(classes(bagged, sums.docs, sums.terms, top), block, weight, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind.simpleString()}")
        found.append(ranked.join(names, "item").select(
            "item_id", "rank", F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id"), "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every
