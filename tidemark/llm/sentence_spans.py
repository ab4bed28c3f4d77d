"""Repeated passages: runs of consecutive pieces of text that occur before in the corpus are removed.

A text is cut into sentences at line ends and after full stops, exclamation and question marks before white space. A sentence
of more than ``LONG`` words is cut further, before words whose hash is least among some ``NEAR`` words in a row: these places
depend on the words around them alone, so copies are cut alike wherever their sentence begins or ends. Pieces have at most
``LONG`` words. From every piece on, and up to every piece, the shortest run of at least ``sentences`` pieces and ``words``
words is hashed (words in lower case, white space aside), so every piece of a repeated passage lies in a run within it. A
passage loses at most ``LONG`` - 1 words at either end to pieces that its neighbours share, so one of more than 50 words, cut
out of its text between any two words and with the same line ends, always holds a run. Runs are grouped by hash over all
documents; a piece goes if a run that is not its hash's first occurrence covers it. The first occurrence is the one of least
(doc_id, hash of the text, place).

Runs are made once and written. Hashes that occur once are left out of the second shuffle by a filter of fixed size; texts that lose nothing are not
shuffled. A very common passage is counted in the map tasks and joined on with one row on the other side.

Defined results: null and empty texts keep their text; rows with equal ids and equal texts count as one document, rows with
equal ids and other texts as several; every row without an id is a document of its own, and these come last in the order;
what is left of a copied document may be empty; repeats within a document go as well. Other columns pass through; ``text``
and ``n_chars`` are renewed where present, ``n_removed`` is added (pieces removed: sentences, or pieces of long ones).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bitmaps
from tidemark.llm.common import stored, whole
from tidemark.llm.shingles import mix

SENTENCES, WORDS = 2, 20
#: Words of the longest piece, and of the stretches that each have a cut in a longer sentence. Twice one less than LONG, and
#: WORDS, are within the 50 words of a passage.
LONG, NEAR = 15, 14
_END = re.compile(r"[.!?]+(?=\s)|\n+")
_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
#: What str.split() takes as white space among the ASCII characters.
_SPACE = np.array([chr(c).isspace() for c in range(128)])


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _Hashes()


def _begins(text: str) -> np.ndarray:
    """Where each word begins."""
    if not text.isascii():
        return np.array([m.start() for m in _WORD.finditer(text)], np.int64)
    within = ~_SPACE[np.frombuffer(text.encode(), np.uint8)]
    first = within.copy()
    first[1:] &= ~within[:-1]
    return np.flatnonzero(first)


def _pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (and, last, the text's length) and word counts of the pieces that hold words, and the hashes of all words."""
    every, begins = text.lower().split(), _begins(text)
    hashes = np.fromiter(map(_HASHES.__getitem__, every), np.uint64, len(every))
    ends = np.array([m.end() for m in _END.finditer(text)] + [len(text)])
    before = np.searchsorted(begins, ends)
    words = np.diff(before, prepend=0)
    ends, before, words = (x[words > 0] for x in (ends, before, words))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    long = words > LONG
    if long.any():
        # a cut of a window wholly in a long sentence, but not at the sentence's first word
        first = np.repeat(before - words, words)
        inside = np.repeat(long, words) & (np.arange(NEAR, len(every) + NEAR) <= np.repeat(before, words))
        cuts = _cuts(hashes)[inside[:len(every) - NEAR + 1]]  # in order
        cuts = cuts[(cuts > first[cuts]) & (np.diff(cuts, prepend=-1) > 0)]
        order = np.argsort(np.concatenate([before - words, cuts]), kind="stable")
        starts = np.concatenate([starts, begins[cuts]])[order]
        words = np.diff(np.concatenate([before - words, cuts])[order], append=len(every))
    return np.append(starts, len(text)), words.astype(np.int64), hashes


def _cuts(hashes: np.ndarray) -> np.ndarray:
    """Of every stretch of ``NEAR`` words the last word of least hash."""
    n, mixed = len(hashes) - NEAR + 1, mix(hashes)
    best, back = mixed[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, NEAR):
        back[mixed[j:n + j] <= best] = j
        np.minimum(best, mixed[j:n + j], out=best)
    return np.arange(n) + back


def sentences_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts (and, last, the text's length) and word counts of the pieces that hold words."""
    return _pieces(text)[:2]


def runs_of(text: str, sentences: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first character and end of every run."""
    run, starts, begin, end = _runs(text, sentences, words)
    return run, starts[begin], starts[end]


def _powers(n: int, kept={}) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, the lesser ones kept."""
    if n > len(kept.get("all", ((),))[0]):
        power = np.full((2, max(n, 10_000)), [[_BASE], [_BACK]], np.uint64)
        power[:, 0] = 1
        made = np.cumprod(power, axis=1)
        if n > 100_000:
            return made[0], made[1]
        kept["all"] = made
    return kept["all"][0][:n], kept["all"][1][:n]


def _runs(text: str, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run, the starts of the pieces, and each run's first piece and the one after its last."""
    starts, many, hashes = _pieces(text)
    n = len(many)
    if n < sentences or len(hashes) < words:
        return np.zeros(0, np.uint64), starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(many)])
    i = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[:-1] + words), i + sentences)  # exclusive
    first = np.minimum(np.searchsorted(total, total[1:] - words, "right") - 1, i + 1 - sentences)
    # runs as one number each, begin and end
    pairs = np.unique(np.concatenate([(i * (n + 1) + last)[last <= n], (first * (n + 1) + i + 1)[first >= 0]]))
    begin, end = pairs // (n + 1), pairs % (n + 1)
    with np.errstate(over="ignore"):
        power, back = _powers(len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power[:-1])])
        run = mix((sums[total[end]] - sums[total[begin]]) * back[total[begin]])
    return run, starts, begin, end


def _emit(batches: Iterator[pd.DataFrame], sentences: int, words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, ties, found = [], [], []
        for doc_id, tie, text in zip(batch["doc_id"], batch["tie"], batch["text"]):
            run, starts, begin, end = _runs(text, sentences, words)
            ids.append(np.full(len(run), doc_id, np.int64))
            ties.append(np.full(len(run), tie, np.int64))
            found.append((run, starts[begin], starts[end], begin, end))
        if found:
            run, *places = (np.concatenate(x) for x in zip(*found))
            yield pd.DataFrame({"run": run.view(np.int64), "doc_id": np.concatenate(ids), "tie": np.concatenate(ties)}
                               | {c: x.astype(np.int32) for c, x in zip(("start", "stop", "piece", "after"), places)})


def _hits(batches: Iterator[pa.RecordBatch], repeated) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(bitmaps.holds(repeated.value, batch.column("run").to_numpy())))


_RUNS = "run long, doc_id long, tie long, start int, stop int, piece int, after int"
_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType())])
_LAST = 2**63 - 1


@F.pandas_udf(_CUT)
def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, gone in zip(texts, spans):
        out, at, n, piece = [], 0, 0, 0
        for start, stop, first, after in sorted((s["start"], s["stop"], s["piece"], s["after"]) for s in gone):
            if stop > at:
                out.append(text[at:max(start, at)])
                n += after - max(first, piece)
                at, piece = stop, after
        rows.append(("".join(out).rstrip() if at == len(text) else "".join(out) + text[at:], n))
    return pd.DataFrame(rows, columns=_CUT.names)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the row key ``_doc``, ``_tie``: the id and a hash of the text. Rows without an id are written and numbered."""
    doc = F.col("doc_id").cast("long")
    void = [c for c, kind in docs.dtypes if kind == "void"]
    bare = stored(docs.where(doc.isNull()).drop(*void).withColumn("_tie", F.monotonically_increasing_id()))
    bare = bare.withColumns({c: F.lit(None) for c in void})
    named = docs.where(doc.isNotNull()).withColumn("_tie", F.xxhash64(whole()))
    return named.unionByName(bare).withColumn("_doc", F.coalesce(doc, F.lit(_LAST)))


def repeated_spans(keyed: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Per row key the spans (start, stop, and the numbers of the first piece and of the one after) of its runs that occur earlier: columns ``doc_id``, ``tie`` and ``spans``."""
    rows = keyed.select(F.col("_doc").alias("doc_id"), F.col("_tie").alias("tie"), whole().alias("text"))
    runs = stored(rows.mapInPandas(partial(_emit, sentences=sentences, words=words), _RUNS))
    place = F.struct("doc_id", "tie", "start")
    first = stored(runs.groupBy("run").agg(F.count("*").alias("times"), F.min(place).alias("first"))
                   .where("times > 1").select("run", "first"))
    lent = keyed.sparkSession.sparkContext.broadcast(bitmaps.of_column(first, "run"))
    again = runs.mapInArrow(partial(_hits, repeated=lent), _RUNS)
    later = again.join(first, "run").where(place != F.col("first"))
    return later.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "stop", "piece", "after")).alias("spans"))


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` without the pieces of later occurrences."""
    keyed = _keyed(docs)
    spans = stored(repeated_spans(keyed, sentences, words))
    keys = ["_doc", "_tie"]
    marked = keyed.withColumn("_may", bitmaps.filter_of(spans.select(F.xxhash64("doc_id", "tie").alias("key")), "key", F.xxhash64(*keys)))
    gone = spans.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("spans").alias("_spans"))
    cut = marked.where("_may").join(gone, keys).withColumn("_cut", _cut(whole(), "_spans"))
    renewed = {"text": F.col("_cut.text"), "n_chars": F.length("_cut.text").cast("long"), "n_removed": F.col("_cut.n_removed")}
    names = [c for c in docs.columns if c != "n_removed"]
    changed = cut.select(*[renewed[c].alias(c) if c in renewed else F.col(f"`{c}`") for c in names], renewed["n_removed"].alias("n_removed"))
    kept = marked.where("_may").join(gone.select(*keys), keys, "left_anti")
    same = [F.col(f"`{c}`") for c in names] + [F.lit(0).alias("n_removed")]
    return changed.unionByName(kept.select(*same)).unionByName(marked.where(~F.col("_may")).select(*same))
