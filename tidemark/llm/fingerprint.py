"""I-Match fingerprints: hashes of the terms whose inverse document frequency lies within a band.

The lexicon holds the terms that a share of all documents between ``low`` and ``high`` contains. A text keeps its distinct
lexicon terms, sorted; the signature of the whole lexicon is their hash. Randomised subsets of the lexicon give more
signatures: a subset of rate r holds a term with chance r, so two texts agree on it if none of the terms in which they
differ is in it. Subsets of several rates make short and long texts comparable, and over the sparse ones the share of
equal signatures follows the overlap of the two texts' terms.

Defined results: null texts count as empty; an empty text has the fingerprint of zeros; a text without any lexicon term
is fingerprinted by all its terms; equal texts have equal fingerprints; repeated rows are fingerprinted each; an empty
table gives no rows. Other columns pass through; the added name replaces a column of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACE, unpacked, whole

#: Subsets as (rate, how many), sparse first.
LEVELS = ((1 / 4096, 16), (1 / 1024, 32), (1 / 256, 32), (1 / 64, 24), (1 / 8, 24))
RATES = np.repeat([r for r, _ in LEVELS], [n for _, n in LEVELS])
#: A likeness is the share of equal signatures among so many sparse subsets that hold a term of either text.
COMPARED = 24


def lexicon(docs: DataFrame, low: float = 0.0005, high: float = 0.1, most: int = 400_000) -> list[str]:
    """Terms in a share of documents from ``low`` to ``high``, all documents counted.

    There are at most (mean distinct terms of a document) / ``low`` such terms whatever the number of documents. Above
    ``most`` the band is narrowed from its rare end until it fits.
    """
    n = docs.count()
    if not n:
        return []
    terms = docs.select(F.explode(F.array_distinct(F.split(F.lower(whole()), SPACE + "+"))).alias("term"))
    inside = (terms.groupBy("term").agg(F.count("*").alias("df"))
              .where((F.col("df") >= low * n) & (F.col("df") <= high * n) & (F.col("term") != "")))
    rows = inside.orderBy(F.desc("df")).limit(most + 1).collect()
    if len(rows) > most:
        rows = [r for r in rows if r.df > rows[-1].df]
    return sorted(r.term for r in rows)


def _membership(terms: list[str]) -> list[bytes]:
    """Per term the subsets that hold it, a byte each: a mixed hash of (term, subset) below the subset's rate."""
    h = np.array([xxhash.xxh64_intdigest(t) for t in terms], dtype=np.uint64)
    inside = np.zeros((len(terms), len(RATES)), dtype=bool)
    with np.errstate(over="ignore"):
        for s, rate in enumerate(RATES):
            x = h ^ np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            inside[:, s] = x < np.uint64(int(rate * 2**64))
    return [np.flatnonzero(row).astype(np.uint8).tobytes() for row in inside]


def fingerprint_of(words: list[str], held: dict[str, bytes]) -> bytes:
    """Eight bytes of the whole lexicon's signature, then two bytes of each subset's, zero where it holds no term."""
    distinct = set(words)
    kept = sorted(distinct & held.keys())
    if not kept:
        kept = sorted(distinct)
        held = dict(zip(kept, _membership(kept)))
    out = np.zeros(len(RATES), dtype=">u2")
    subsets: dict[int, list[str]] = {}
    for term in kept:
        for s in held[term]:
            subsets.setdefault(s, []).append(term)
    for s, terms in subsets.items():
        out[s] = xxhash.xxh64_intdigest("\n".join(terms), s) % 65535 + 1
    first = xxhash.xxh64_intdigest("\n".join(kept)) if kept else 0
    return first.to_bytes(8, "big") + out.tobytes()


def fingerprints(docs: DataFrame, terms: list[str], text: Column | None = None, out: str = "fingerprint",
                 packed_as: str | None = None) -> DataFrame:
    """``docs`` with the binary fingerprint of ``text``, and with ``packed_as`` the text compressed, in one Python step.

    ``terms``: the lexicon, of bounded size."""
    lent = docs.sparkSession.sparkContext.broadcast(terms)
    kind = T.StructType([T.StructField(n, T.BinaryType()) for n in ("print", *(["packed"] if packed_as else []))])

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, press = dict(zip(lent.value, _membership(lent.value))), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            made = {"print": pd.Series([fingerprint_of(t.lower().split(), held) for t in batch], dtype=object)}
            if packed_as:
                made["packed"] = pd.Series([press.compress(t.encode()) for t in batch], dtype=object)
            yield pd.DataFrame(made)

    done = docs.withColumn("_made", apply(whole() if text is None else text))
    more = {packed_as: F.col("_made.packed")} if packed_as else {}
    return done.withColumns({out: F.col("_made.print"), **more}).drop("_made")


def edited(pairs: DataFrame, terms: list[str], text: str, donor: str, own: str, other: str) -> DataFrame:
    """Fingerprint and digest of texts whose second half gives way to the donor's start, and how near texts are.

    ``text`` and ``donor`` are packed. The last floor(n / 2) code points are replaced by as many of the donor's first ones,
    or by all of them. Adds ``edited_sha256``, ``edited_fingerprint``, and the likeness of the fingerprint ``own`` to that
    one and to the fingerprint ``other``: ``near_edited``, ``near_next``. All of it is one Python step.
    """
    lent = pairs.sparkSession.sparkContext.broadcast(terms)
    kind = T.StructType([T.StructField("edited_sha256", T.StringType()), T.StructField("edited_fingerprint", T.BinaryType()),
                         T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    @F.pandas_udf(kind)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        held = dict(zip(lent.value, _membership(lent.value)))
        for texts, donors, prints, others in batches:
            digests, made = [], []
            for a, b in zip(texts, donors):
                a, b = unpacked(a), unpacked(b)
                half = len(a) // 2
                new = a[:len(a) - half] + b[:half]
                digests.append(hashlib.sha256(new.encode()).hexdigest())
                made.append(fingerprint_of(new.lower().split(), held))
            yield pd.DataFrame({"edited_sha256": pd.Series(digests, dtype=object), "edited_fingerprint": pd.Series(made, dtype=object),
                                "near_edited": alike(prints, made), "near_next": alike(prints, others)})

    done = pairs.withColumn("_edited", apply(text, donor, own, other))
    return done.withColumns({n: F.col(f"_edited.{n}") for n in kind.names}).drop("_edited")


def alike(left: Iterable[bytes], right: Iterable[bytes]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1: 1 where the whole lexicon's signatures agree."""
    width = 8 + 2 * len(RATES)
    a, b = (np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, width) for x in (left, right))
    same = (a[:, :8] == b[:, :8]).all(axis=1)
    a, b = (np.ascontiguousarray(x[:, 8:]).view(">u2") for x in (a, b))
    used = (a | b) != 0
    used &= np.cumsum(used, axis=1) <= COMPARED
    n = used.sum(axis=1)
    equal = (used & (a == b)).sum(axis=1)
    return np.where(same, 1.0, equal / np.maximum(n, 1))


@F.pandas_udf(T.DoubleType())
def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints."""
    return pd.Series(alike(left, right))
