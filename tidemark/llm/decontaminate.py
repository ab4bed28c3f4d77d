"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, found by a multi-index of Hamming blocks.

A window's fingerprint is the sign, bit by bit, of the weighted sum of its words' hashes; words that many items share weigh
less. Documents are cut into windows on a grid of every fourth word, in a ladder of lengths; an item gives fingerprints of
all its sub-windows of the longest ladder length that fits, whatever its position on the grid, and of about half that. So
a copied item meets a window of equal fingerprint. Fingerprints of 64 bits are cut into four blocks of 16: two within seven
bits differ by one bit at most in some block, so looking up each block, with all its one-bit neighbours, finds every pair
within the radius. A found pair is aligned, and the share of the item's five-word shingles in the document's stretch,
weighted by their words, must reach ``least``.

Edited copies of short items have no untouched sub-window, and few changed words flip many bits. So pairs also come from the
items' shingles, looked up at every word of a document, whatever the item's length: a pair is aligned wherever a shingle
stands if the shingles that the document shares weigh ``least`` of the item's at all. A stretch that reaches ``least`` in the
item's own alignment is always found.

Items are lent to every task in slices of bounded size, each one pass over the documents; nothing is shuffled.

Defined results: null and empty texts have no leaks; null or empty items match nothing; items of fewer than 15 words are
looked up at every word and those shorter than a shingle are one shingle; equal items are reported each; repeated rows are
searched each; the added column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import whole
from tidemark.llm.shingles import WIDTH, mix, words

LEAST = 0.75
RADIUS = 7
GRID = 4
LADDER = (12, 16, 20, 24, 32, 40, 52, 68, 88, 116, 152, 200, 260, 340, 440, 580)
SHORT = LADDER[0] + GRID - 1
#: Items of one pass.
SLICE = 20_000
#: Texts split at once, and words worked on at once.
ROWS, CHUNK = 200, 60_000
#: Share of items above which a word weighs 1, and 2; other words weigh 3.
COMMON = ((0.1, 1), (0.02, 2))

LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("similarity", T.DoubleType())]))


def _hashes(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of the words of every text."""
    hashes, many = words(texts)
    return np.split(hashes, np.cumsum(many)[:-1])


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted ``known``, and where. ``known`` is not empty."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


class Weights:
    """Puts the weight of a word into the two lowest bits of its hash. Words that many of the texts share weigh less than 3."""

    def __init__(self, hashes: list[np.ndarray]):
        known, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, hashes)]), return_counts=True)
        weight = np.full(len(known), 3, np.uint64)
        for share, light in reversed(COMMON):
            weight[count > max(1, share * len(hashes))] = light
        self.light, self.weight = known[weight < 3], weight[weight < 3]
        #: By the lowest 16 bits, whether a light word may have such a hash.
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.light & np.uint64(0xFFFF)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes | np.uint64(3)
        maybe = np.nonzero(self.filter[hashes & np.uint64(0xFFFF)])[0]
        if len(maybe):
            light, at = _among(hashes[maybe], self.light)
            out[maybe[light]] += self.weight[at[light]] - np.uint64(3)
        return out


def _leanings(hashes: np.ndarray, step: int) -> np.ndarray:
    """Per group of ``step`` words and bit: the weight of the words that have it, less that of the others."""
    n = len(hashes) // step * step
    hashes = hashes[:n]
    weight = (hashes & np.uint64(3)).astype(np.uint8)
    bits = np.unpackbits(mix(hashes >> np.uint64(2)).view(np.uint8).reshape(n, 8), axis=1)
    bits *= weight[:, None]
    return 2 * bits.reshape(-1, step, 64).sum(axis=1, dtype=np.int16) - weight.reshape(-1, step).sum(axis=1, dtype=np.int16)[:, None]


class Runs:
    """Sums over runs of rows, put together from runs of 1, 2, 4 .. rows: neighbours are added, and no sum outgrows its window."""

    def __init__(self, rows: np.ndarray):
        self.doubled = [rows]

    def of(self, length: int) -> np.ndarray:
        """The sum of every run of so many rows, by its first row."""
        while len(self.doubled) < length.bit_length():
            last, size = self.doubled[-1], 1 << len(self.doubled) - 1
            self.doubled.append(last[:-size] + last[size:])
        out, begin, n = None, 0, len(self.doubled[0]) - length + 1
        for k in range(length.bit_length()):
            if length >> k & 1:
                part = self.doubled[k][begin:begin + n]
                out, begin = part if out is None else out + part, begin + (1 << k)
        return out


def _window_prints(leanings: Runs, length: int) -> np.ndarray:
    """Fingerprints of all windows of so many groups: the bits that more than half of the weight has."""
    return np.packbits(leanings.of(length) > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of one window length, with the item and the offset of each."""

    def __init__(self, prints: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        self.prints, self.items, self.offsets = prints, items, offsets
        blocks = prints[:, None] >> np.array([0, 16, 32, 48], np.uint64) & np.uint64(0xFFFF)
        flips = np.array([0, *(1 << i for i in range(16))], np.uint64)
        self.tables = []
        for b in range(4):
            keys = (blocks[:, b, None] ^ flips).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            begin = np.searchsorted(keys[order], np.arange(65537))
            self.tables.append((np.diff(begin) > 0, begin, np.repeat(np.arange(len(prints)), 17)[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, fingerprint) within the radius."""
        found = []
        for b, (known, begin, rows) in enumerate(self.tables):
            keys = (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            at = np.nonzero(known[keys])[0]
            if len(at):
                window, row = _spread(begin[keys[at]], begin[keys[at] + 1])
                window, row = at[window], rows[row]
                close = np.bitwise_count(prints[window] ^ self.prints[row]) <= RADIUS
                found.append(window[close] * len(self.prints) + row[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.divmod(pairs, len(self.prints))


class Seeds:
    """Shingles of one width by hash, with the item and the offset of each."""

    #: Bits of the filter of shingles.
    MASK = np.uint64((1 << 22) - 1)

    def __init__(self, hashes: np.ndarray, items: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
        order = np.lexsort((offsets, items, hashes))
        self.hashes, self.items, self.offsets, self.weights = hashes[order], items[order], offsets[order], weights[order]
        #: The first of each item's equal shingles.
        self.fresh = np.concatenate([[True], (np.diff(self.hashes) != 0) | (np.diff(self.items) != 0)])
        self.filter = np.zeros(1 << 22, bool)
        self.filter[hashes & self.MASK] = True

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose shingle is known, and the first and last (exclusive) of its rows."""
        at = np.nonzero(self.filter[shingles & self.MASK])[0]
        first, last = (np.searchsorted(self.hashes, shingles[at], side) for side in ("left", "right"))
        known = last > first
        return at[known], first[known], last[known]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ranges, and all their members."""
    many = last - first
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many - first, many)


class Items:
    """The benchmark, ready for searching."""

    def __init__(self, ids: list[int], texts: list[str]):
        plain = _hashes(pa.array([t or "" for t in texts], pa.string())) if texts else []
        self.ids = ids
        self.weights = Weights(plain)
        self.hashes = [self.weights.of(h) for h in plain]
        self.shingles = [_shingles(h) for h in self.hashes]
        self.least = np.array([LEAST * weight.sum() for _, weight in self.shingles])
        parts: dict[tuple[int, int], list] = {}
        seeds: dict[int, list] = {}
        for i, h in enumerate(self.hashes):
            m = len(h)
            if not m:
                continue
            every = _rolled(h, min(WIDTH, m))
            seeds.setdefault(min(WIDTH, m), []).append((every, np.full(len(every), i), np.arange(len(every)), _rolled_weights(h, min(WIDTH, m))))
            if m < SHORT:
                wanted = [(m, 1)]
            else:
                fits = [size for size in LADDER if size <= m - GRID + 1]
                wanted = sorted({(fits[-1], GRID), *((s, GRID) for s in fits if s <= m * 0.55 and m >= 30 and s == max(
                    x for x in fits if x <= m * 0.55))})
            leanings = Runs(_leanings(h, 1))
            for size, step in wanted:
                prints = _window_prints(leanings, size)
                parts.setdefault((size, step), []).append((prints, np.full(len(prints), i), np.arange(len(prints))))
        self.indexes = {k: Index(*(np.concatenate(x) for x in zip(*v))) for k, v in parts.items()}
        self.seeds = {k: Seeds(*(np.concatenate(x) for x in zip(*v))) for k, v in seeds.items()}

    def find(self, texts: list[str] | pa.Array) -> list[list[tuple[int, int, float]]]:
        """Per text its leaks: item, first word, similarity; the best place of each item."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[list] = []
        batch: list[np.ndarray] = []
        size = 0
        for at in range(0, len(texts), ROWS):
            for hashes in _hashes(texts.slice(at, ROWS)):
                batch.append(hashes)
                size += len(hashes)
                if size >= CHUNK:
                    out += self._find(batch)
                    batch, size = [], 0
        return out + self._find(batch)

    def _find(self, docs: list[np.ndarray]) -> list[list]:
        best: list[dict] = [{} for _ in docs]
        if not docs or not self.indexes:
            return [[] for _ in docs]
        hashes = self.weights.of(np.concatenate(docs))
        ends = np.cumsum([len(d) for d in docs])
        docs = np.split(hashes, ends[:-1])
        shared = [(seeds, *self._shared(seeds, hashes, ends, width)) for width, seeds in self.seeds.items() if len(hashes) >= width]
        pairs = np.concatenate([np.zeros(0, np.int64), *(pair for *_, pair in shared)])
        tried = set()

        def attempt(doc: int, item: int, start: int) -> None:
            if (doc, item, start) in tried:
                return
            tried.add((doc, item, start))
            begin = int(ends[doc]) - len(docs[doc])
            slack = 2 if len(self.hashes[item]) >= WIDTH else 0  # words more at either end allow for shifts
            like = self._similarity(item, docs[doc], start - begin, slack)
            if like >= LEAST:
                rank = (like, self._similarity(item, docs[doc], start - begin, 0), begin - start)
                best[doc][item] = max(rank, best[doc].get(item, rank))

        for step in sorted({s for _, s in self.indexes}):
            leanings = Runs(_leanings(hashes, step))
            for (size, own_step), index in self.indexes.items():
                if own_step != step or len(hashes) // step < size // step:
                    continue
                window, row = index.near(_window_prints(leanings, size // step))
                doc = np.searchsorted(ends, window * step, "right")
                inside = window * step + size <= ends[np.minimum(doc, len(ends) - 1)]
                window, row, doc = window[inside] * step, row[inside], doc[inside]
                # where the shared shingles weigh too little, no alignment reaches ``least``
                enough = np.isin(doc * len(self.ids) + index.items[row], pairs)
                starts = np.stack([doc, index.items[row], window - index.offsets[row]], axis=1)[enough]
                for doc, item, start in starts.tolist():
                    attempt(doc, item, start)
        for doc, item, start in self._seeded(shared, ends):
            attempt(doc, item, start)
        return [[(self.ids[i], max(-v[2], 0), v[0]) for i, v in sorted(found.items())] for found in best]

    def _shared(self, seeds: Seeds, hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """All hits of the shingles: place, first and last of their rows, document; and as document * number of items + item the pairs
        whose shared shingles weigh enough."""
        at, first, last = seeds.hits(_rolled(hashes, width))
        doc = np.searchsorted(ends, at, "right")
        inside = at + width <= ends[doc]
        at, first, last, doc = at[inside], first[inside], last[inside], doc[inside]
        # one hit of each shingle in each document: the weight of what it shares with every item
        once = np.unique(doc * (len(seeds.hashes) + 1) + first, return_index=True)[1]
        owner, row = _spread(first[once], last[once])
        owner, row = owner[seeds.fresh[row]], row[seeds.fresh[row]]
        pair, which = np.unique(doc[once][owner] * len(self.ids) + seeds.items[row], return_inverse=True)
        weight = np.bincount(which, seeds.weights[row], minlength=len(pair))
        return at, first, last, doc, pair[weight >= self.least[pair % len(self.ids)] - 1e-6]

    def _seeded(self, shared: list[tuple], ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Document, item and start of all alignments by a shared shingle, where the shared shingles can weigh enough."""
        for seeds, at, first, last, doc, pair in shared:
            if not len(pair):
                continue
            near = np.isin(doc, pair // len(self.ids))
            at, first, last, doc = at[near], first[near], last[near], doc[near]
            # a bounded number of alignments at a time
            cuts = np.searchsorted(np.cumsum(last - first), np.arange(0, int((last - first).sum()), 2_000_000)[1:])
            for part in np.split(np.arange(len(at)), cuts):
                owner, row = _spread(first[part], last[part])
                owner = part[owner]
                good = np.isin(doc[owner] * len(self.ids) + seeds.items[row], pair)
                owner, row = owner[good], row[good]
                starts = np.stack([doc[owner], seeds.items[row], at[owner] - seeds.offsets[row]], axis=1)
                yield from map(tuple, np.unique(starts, axis=0).tolist())

    def _similarity(self, item: int, doc: np.ndarray, start: int, slack: int) -> float:
        """Weighted share of the item's shingles that the stretch holds."""
        want, weight = self.shingles[item]
        stretch = doc[max(start - slack, 0):max(start + len(self.hashes[item]) + slack, 0)]
        if not len(stretch):
            return 0.0
        held, _ = _among(want, np.sort(_rolled(stretch, min(WIDTH, len(stretch)))))
        return float(weight[held].sum() / weight.sum())


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The shingle at every word."""
    n = len(hashes) - width + 1
    acc = np.full(n, np.uint64(width))
    for j in range(width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n])
    return acc


def _rolled_weights(hashes: np.ndarray, width: int) -> np.ndarray:
    """The weight of the shingle at every word: its words' weights summed."""
    return np.convolve((hashes & np.uint64(3)).astype(float), np.ones(width), "valid")


def _shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and the weight of each."""
    if not len(hashes):
        return hashes, np.array([1.0])
    width = min(WIDTH, len(hashes))
    kept, first = np.unique(_rolled(hashes, width), return_index=True)
    return kept, _rolled_weights(hashes, width)[first]


def find_leaks(docs: DataFrame, items: DataFrame, out: str = "leaks") -> DataFrame:
    """``docs`` with the array ``out`` of (item_id, start, similarity): the items found in each text, first word from 0."""
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0))
    slices = max(1, -(-known.count() // SLICE))
    parts = []
    for k in range(slices):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()
        rows.sort(key=lambda r: (r.item_id, r.text))
        parts.append(_finder(spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows])))(whole()))
    return docs.withColumn(out, F.concat(*parts))


def _finder(lent):
    @F.arrow_udf(LEAKS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items, kind = Items(*lent.value), to_arrow_type(LEAKS)
        for batch in batches:
            yield pa.array([[dict(zip(("item_id", "start", "similarity"), leak)) for leak in leaks] for leaks in items.find(batch)], kind)

    return find
