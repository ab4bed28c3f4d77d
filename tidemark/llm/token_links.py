"""How the tokens of two tokenizers lie over each other: a byte-level BPE (side A) and a SentencePiece model (side B).

Every text is encoded once by both sides, and both sides' tokens become byte ranges over the same bytes (a space and the
text). Tasks take a few texts at a time as two tables of (document, start, token), and ``pandas.merge_asof``, keyed by document,
finds for each token's start the other side's token that covers it; the union of both directions is the set of overlaps: of
two tokens that overlap, the one that starts later starts inside the other. Ends that both sides share cut the tokens into
groups.

In how many documents a pair of ids is linked is counted over the corpus from each document's distinct pairs, which are
written once; map tasks add up first. Each document then sums over its own pairs. The table of counts goes to the tasks in
slices of at most ``PAIRS`` pairs by A's id, one pass over the stored pairs for each (the sums add up), so no text and no
document's pairs are shuffled and no task holds more than a slice, however many pairs there are.

A's ranks are read from its tokenizer file and used by the fast encoder where merge order and id order agree (checked); long
runs without a break go to the file's own library. Texts of more than ``LONG`` characters are cut, for encoding alone, at
single spaces between ASCII letters, where neither side can join anything (checked for B's pieces).

Defined results: texts that are null or empty, or whose joined token bytes on either side differ from space and text, have no
tokens: zeros, empty arrays, and an empty string instead of the digest. Rows are documents of their own, equal ids or none
included. Other columns pass through where kept by name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import stored
from tidemark.llm.pieces import _processor, raw_pieces

#: Pairs of ids in one slice of the table of counts (some 13 bytes each).
PAIRS = 4_000_000
#: Characters of texts that tasks align at a time, and of a stretch that is encoded at a time.
STEP, LONG = 300_000, 200_000
#: The split before A's merges (a fixed value of its kind of vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNBROKEN = re.compile(r"\S{1000}|\s{1000}")
_PLACE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def stretches(text: str, most: int = LONG) -> list[str]:
    """The text in parts of little more than ``most`` characters, cut before single spaces between letters; whole if it has none."""
    out, at = [], 0
    while len(text) - at > most:
        place = _PLACE.search(text, at + most)
        if place is None:
            break
        out.append(text[at:place.start()])
        at = place.start()
    return [*out, text[at:]]


class Sides:
    """Both encoders, and the bytes of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.slow = Tokenizer.from_str(a_file.decode())
        self.slow.encode_special_tokens = True
        told = json.loads(a_file)
        byte = _byte_of()
        known = self.slow.get_vocab(with_added_tokens=True)
        added = {x["content"] for x in told.get("added_tokens", [])}
        raw = {i: bytes(byte[c] for c in token) if token not in added else token.encode() for token, i in known.items()}
        self.a_size = max(raw) + 1
        self.a_raw = [raw.get(i, b"") for i in range(self.a_size)]
        merges = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        ids = [known["".join(x)] for x in merges]
        split = told["pre_tokenizer"] or {}
        ordered = all(x < y for x, y in zip(ids, ids[1:])) and (not ids or ids[0] >= 256) and told["normalizer"] is None
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.fast = None
        if ordered and plain:
            ranks = {raw[i]: i for token, i in known.items() if token not in added}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = _processor(b_file)
        self.b_raw = raw_pieces(b_file)
        self.b_size = len(self.b_raw)
        # a piece with a space after another character could lie across a cut
        self.b_cut = not any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b_size)))
        self.a_len = np.array([len(x) for x in self.a_raw], np.int64)
        self.b_len = np.array([len(x) for x in self.b_raw], np.int64)
        #: Ids as text with what follows them: the next of the run, the other side, the next group, or nothing.
        names = [str(i).encode() for i in range(max(self.a_size, self.b_size))]
        self.names = np.array([[n + end for n in names] for end in (b",", b"|", b";", b"")], object)
        self.cut = plain and told["normalizer"] is None

    def _a(self, text: str) -> np.ndarray:
        if self.fast is None or _UNBROKEN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; empty where a side does not give space and text back."""
        b_parts = [stretches(t) if self.b_cut else [t] for t in texts]
        flat = [part[k > 0:] for parts in b_parts for k, part in enumerate(parts)]
        b_ids = iter(self.b.encode(flat, num_threads=1))
        out, none = [], np.zeros(0, np.int64)
        for text, parts in zip(texts, b_parts):
            b = [i for _ in parts for i in next(b_ids)]
            if text:
                a_parts = stretches(text) if self.cut else [text]
                a = np.concatenate([self._a(p if k else " " + p) for k, p in enumerate(a_parts)])
                whole = (" " + text).encode("utf-8", "surrogatepass")
                a_raw, b_raw = self.a_raw.__getitem__, self.b_raw.__getitem__
                if b"".join(map(b_raw, b)) == whole and b"".join(map(a_raw, a.tolist())) == whole:
                    out.append((a, np.array(b, np.int64)))
                    continue
            out.append((none, none))
        return out


def _table(ids: list[np.ndarray], length: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, id, start and end of every token; starts grow over the documents."""
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    own = np.concatenate(ids)
    n = length[own]
    ends = np.cumsum(n)
    first = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) for x in ids)])[:-1]]
    ends = ends - first[doc] + base[doc]
    return doc, own, ends - n, ends


def links(a_doc, a_start, b_doc, b_start) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of overlapping tokens, each once. Tokens are in order of document and start and none is empty."""
    a = pd.DataFrame({"doc": a_doc, "start": a_start, "a": np.arange(len(a_doc)), "a_start": a_start})
    b = pd.DataFrame({"doc": b_doc, "start": b_start, "b": np.arange(len(b_doc)), "b_start": b_start})
    from_a = pd.merge_asof(a, b, on="start", by="doc")
    from_b = pd.merge_asof(b, a, on="start", by="doc")
    # pairs that start together come from both directions
    later = from_b["a_start"].to_numpy() != from_b["b_start"].to_numpy()
    return (np.concatenate([from_a["a"].to_numpy(), from_b["a"].to_numpy()[later]]).astype(np.int64),
            np.concatenate([from_a["b"].to_numpy(), from_b["b"].to_numpy()[later]]).astype(np.int64))


def align_texts(texts: list[str], sides: Sides) -> pd.DataFrame:
    """Per text ``a_ids``, ``b_ids``, the groups' last tokens as counts ``a_ends``, ``b_ends``, and its distinct linked ``pairs``
    (A's id times the number of B's ids, plus B's) with how often each is linked."""
    coded = sides.encode(texts)
    a_ids, b_ids = [a for a, _ in coded], [b for _, b in coded]
    n = np.array([int(sides.a_len[a].sum()) for a in a_ids])
    base = np.cumsum(n + 1) - n - 1
    a_doc, a, a_start, a_end = _table(a_ids, sides.a_len, base)
    b_doc, b, b_start, b_end = _table(b_ids, sides.b_len, base)
    a_at, b_at = (np.flatnonzero(x > y) for x, y in ((a_end, a_start), (b_end, b_start)))
    left, right = links(a_doc[a_at], a_start[a_at], b_doc[b_at], b_start[b_at])
    left, right = a_at[left], b_at[right]
    many = sides.a_size * sides.b_size
    keys, times = np.unique(a_doc[left] * many + a[left] * sides.b_size + b[right], return_counts=True)
    cuts = np.searchsorted(keys // many, np.arange(len(texts) + 1))
    ends = np.intersect1d(a_end, b_end)
    a_last, b_last = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
    first = np.searchsorted(ends, np.append(base, base[-1:] + n[-1:] + 1), "left") if len(ends) else np.zeros(len(texts) + 1, np.int64)
    a_first, b_first = np.cumsum([0, *map(len, a_ids)]), np.cumsum([0, *map(len, b_ids)])
    rows = []
    for k in range(len(texts)):
        own = slice(first[k], first[k + 1])
        rows.append((a_ids[k], b_ids[k], a_last[own] - a_first[k], b_last[own] - b_first[k],
                     keys[cuts[k]:cuts[k + 1]] % many, times[cuts[k]:cuts[k + 1]]))
    return pd.DataFrame(rows, columns=["a_ids", "b_ids", "a_ends", "b_ends", "pairs", "times"])


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, names: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    if not len(a_ends):
        return b""
    a_sep, b_sep = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_sep[a_ends - 1], b_sep[b_ends - 1] = 1, 2
    b_sep[-1] = 3
    # each side's tokens go after the other's of the groups before
    group_a = np.repeat(np.arange(len(a_ends)), np.diff(a_ends, prepend=0))
    group_b = np.repeat(np.arange(len(b_ends)), np.diff(b_ends, prepend=0))
    out = np.empty(len(a_ids) + len(b_ids), object)
    out[np.arange(len(a_ids)) + np.concatenate([[0], b_ends])[group_a]] = names[a_sep, a_ids]
    out[np.arange(len(b_ids)) + a_ends[group_b]] = names[b_sep, b_ids]
    return b"".join(out.tolist())


_kept: dict = {}


def _sides(lent) -> Sides:
    """One per worker process."""
    name = tuple(hashlib.sha256(x).digest() for x in lent.value)
    if name not in _kept:
        _kept.clear()
        _kept[name] = Sides(*lent.value)
    return _kept[name]


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with texts of ``STEP`` characters together, or one row."""
    at = seen = 0
    for k, text in enumerate(texts):
        seen += len(text or "") + 1
        if seen >= STEP:
            yield at, k + 1
            at, seen = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _aligned(batches: Iterator[pa.RecordBatch], lent, digest: bool) -> Iterator[pa.RecordBatch]:
    sides = _sides(lent)
    for batch in batches:
        sizes = batch.column("_text")
        for a, b in _portions(sizes.to_pylist()):
            part = batch.slice(a, b - a)
            found = align_texts([t or "" for t in part.column("_text").to_pylist()], sides)
            names = [x for x in part.schema.names if x != "_text"]
            columns = [part.column(x) for x in names]
            if digest:
                text = [groups_text(*row, sides.names) for row in zip(*(found[c] for c in ("a_ids", "b_ids", "a_ends", "b_ends")))]
                own = {"n_a": found["a_ids"].map(len), "n_b": found["b_ids"].map(len), "n_groups": found["a_ends"].map(len),
                       "n_links": found["times"].map(lambda t: int(t.sum()))}
                columns += [pa.array(v.to_numpy().astype(np.int64), pa.int64()) for v in own.values()]
                columns.append(pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in text], pa.string()))
                names += [*own, "groups_sha256"]
            lists = ["pairs", "times"] if digest else ["a_ids", "b_ids", "a_ends", "b_ends", "pairs", "times"]
            code = np.int32 if sides.a_size * sides.b_size < 2**31 else np.int64
            for c in lists:
                kind = code if c == "pairs" else np.int32
                offsets = np.cumsum([0, *map(len, found[c])]).astype(np.int32)
                flat = np.concatenate(found[c].to_list()).astype(kind)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names + lists)


def _run(docs: DataFrame, a_file: bytes, b_file: bytes, keep: tuple[str, ...], digest: bool) -> DataFrame:
    lent = docs.sparkSession.sparkContext.broadcast((a_file, b_file))
    sides = Sides(a_file, b_file)
    code = T.IntegerType() if sides.a_size * sides.b_size < 2**31 else T.LongType()
    rows = docs.select(*keep, F.col("text").alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    if digest:
        fields += [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
        fields.append(T.StructField("groups_sha256", T.StringType()))
    else:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a_ids", "b_ids", "a_ends", "b_ends")]
    fields += [T.StructField("pairs", T.ArrayType(code)), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(lambda batches: _aligned(batches, lent, digest), T.StructType(fields))


def align(docs: DataFrame, a_file: bytes, b_file: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document both sides' ids, where groups end on either side (in tokens), and the linked pairs with their times."""
    return _run(docs, a_file, b_file, keep, digest=False)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``pair``, ``a``, the number of ``docs`` that hold it linked, and whether none of A's other pairs has more (``best``)."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
                    .withColumn("a", F.expr(f"pair div {b_size}L")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return stored(counts.join(most, "a").select("pair", "a", "docs", (F.col("docs") == F.col("most")).alias("best")))


def _ranges(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of A's ids with at most ``most`` pairs, or one id; there are no more numbers than A has ids."""
    out, seen = [], 0
    for row in counts.groupBy("a").count().orderBy("a").collect():
        if not out or seen + row["count"] > most:
            out.append((row.a, row.a))
            seen = 0
        out[-1] = out[-1][0], row.a
        seen += row["count"]
    return out


def link_sums(aligned: DataFrame, counts: DataFrame, keep: tuple[str, ...], most: int = PAIRS) -> DataFrame:
    """The kept columns, with ``n_best`` and ``count_sum`` over the links of every row."""
    spark = aligned.sparkSession
    fields = T.StructType([*aligned.select(*keep).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def one(low: int, high: int) -> DataFrame:
        rows = counts.where(F.col("a").between(low, high)).select("pair", "docs", "best").toArrow().sort_by("pair")
        lent = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "docs", "best")))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, docs, best = lent.value
            for batch in batches:
                pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
                offsets = pairs.offsets.to_numpy()
                flat = pairs.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = known[at] == flat
                sums = [np.concatenate([[0], np.cumsum(np.where(hit, x[at], 0) * times)]) for x in (best, docs)]
                own = offsets - offsets[0]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), *(pa.array(s[own[1:]] - s[own[:-1]], pa.int64()) for s in sums)],
                    [*keep, "n_best", "count_sum"])

        return aligned.select(*keep, "pairs", "times").mapInArrow(add, fields)

    parts = [one(low, high) for low, high in _ranges(counts, most)]
    if not parts:
        return aligned.select(*keep, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    if len(parts) == 1:
        return parts[0]
    # a pass for each slice; a row's sums add up
    every = stored(parts[0])
    for more in parts[1:]:
        every = every.unionAll(stored(more))
    return every.groupBy(*keep).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(docs: DataFrame, a_file: bytes, b_file: bytes, keep: tuple[str, ...] = ("doc_id",), most: int = PAIRS) -> DataFrame:
    """The kept columns, numbers of tokens, groups and links, the digest of the groups, and the sums over the links."""
    own = (*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    aligned = stored(_run(docs, a_file, b_file, keep, digest=True).withColumn("_row", F.monotonically_increasing_id()))
    counts = pair_counts(aligned, len(raw_pieces(b_file)))
    return link_sums(aligned, counts, ("_row", *own), most).drop("_row")
