"""Document quality from a linear-chain conditional random field over lines.

Every line gets a state, good or bad. Emissions are linear in features of the line and of the lines before and after it;
transitions tie neighbouring lines. The forward-backward recursion gives each line's chance of being good; a document's
share of good text is the mean of these chances weighted by line length, and a logistic curve fitted on the training
documents turns it into a score from 0 to 1.

The model is fitted in the driver on at most ``most`` labelled documents, chosen by a hash of doc_id, of at most
``most_lines`` lines each; only their line features are gathered. A line first takes its document's label; a second fit
relabels lines of bad documents that look good. Scoring covers every document whole and shuffles nothing. Labels,
language, source and doc_id are never inputs of a score.

Defined results: null texts count as empty; an empty text is one empty line and is scored; repeated rows are scored each;
without labelled rows of both kinds every score is 0.5; added columns replace columns of their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import whole

MOST, MOST_LINES = 4000, 400
LETTER, UPPER, DIGIT, SPACE, NEWLINE, MARK, SHOUT, PIPE, SYMBOL = range(9)
#: Characters worked on at once; a longer document is worked on alone.
CHUNK = 1_000_000


def _classes() -> np.ndarray:
    out = np.zeros(0x3000, dtype=np.uint8)
    for i in range(len(out)):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = (NEWLINE if c == "\n" else SPACE if c.isspace() else SHOUT if c == "!" else PIPE if c == "|"
                  else MARK if c in ".,;:?'\"()-" else UPPER if kind == "Lu" else DIGIT if kind == "Nd"
                  else LETTER if kind[0] in "LM" else SYMBOL)
    return out


_CLASS = _classes()
N_OWN = 13


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, lines per text, characters per line."""
    per_text = np.array([t.count("\n") + 1 for t in texts])
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4")
    kinds = np.where(codes < len(_CLASS), _CLASS[np.minimum(codes, len(_CLASS) - 1)], LETTER)
    ends = np.nonzero(kinds == NEWLINE)[0]
    lines = len(ends)
    size = np.diff(ends, prepend=-1)
    line = np.repeat(np.arange(lines), size)
    counts = np.bincount(line * 9 + kinds, minlength=lines * 9).reshape(lines, 9).astype(float)
    chars = size - 1.0

    solid = (kinds != SPACE) & (kinds != NEWLINE)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.nonzero(first)[0]
    words = np.bincount(line[starts], minlength=lines).astype(float)
    out = np.zeros((lines, N_OWN))
    if len(starts):
        at = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) if starts[0] == 0 else \
            np.arange(len(codes)) - np.concatenate([np.zeros(starts[0], int), np.repeat(starts, np.diff(np.append(starts, len(codes))))])
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * ((at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(29)
        sums = np.add.reduceat(np.where(solid, mixed, np.uint64(0)), starts)
        length = np.add.reduceat(solid.astype(np.int64), starts)
        same = np.concatenate([[False], sums[1:] == sums[:-1]])
        last = kinds[starts + length - 1]
        of = line[starts]
        out[:, 8] = np.bincount(of, length, minlength=lines) / np.maximum(words, 1) / 10
        out[:, 9] = np.bincount(of, same, minlength=lines) / np.maximum(words, 1)
        out[:, 10] = np.bincount(of, last >= SHOUT, minlength=lines) / np.maximum(words, 1)
    letters = counts[:, LETTER] + counts[:, UPPER]
    every = np.maximum(chars, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(chars)
    out[:, 2] = counts[:, UPPER] / np.maximum(letters, 1)
    for i, kind in enumerate((DIGIT, MARK, SHOUT, PIPE, SYMBOL)):
        out[:, 3 + i] = counts[:, kind] / every
    out[:, 11] = kinds[np.maximum(ends - 1, 0)] == MARK
    out[:, 12] = chars == 0
    return _with_neighbours(out, per_text), per_text, chars


def _with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    last = np.cumsum(per_text) - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[last - per_text + 1] = 0
    after[last] = 0
    edge = np.zeros((len(own), 2))
    edge[last - per_text + 1, 0] = 1
    edge[last, 1] = 1
    return np.hstack([own, before, after, edge])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # emission of good over bad; the last is the bias
    moves: np.ndarray  # transition weights, [from, to]
    slope: float
    shift: float


def marginals(emission: np.ndarray, per_text: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per line the chance of good; summed expected transitions; summed log partition functions.

    Texts are ordered by falling length, so that each step works on the texts that still have lines, at once.
    """
    order = np.argsort(-per_text, kind="stable")
    begin = (np.cumsum(per_text) - per_text)[order]
    lengths = per_text[order]
    steps = int(lengths[0])
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps + 1)]  # texts with more than t lines
    total = len(emission)
    e = np.stack([np.zeros(total), emission], axis=1)
    forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
    for t in range(steps):
        at = begin[:active[t]] + t
        if t:
            p = forward[at - 1]
            forward[at] = e[at] + np.stack([np.logaddexp(p[:, 0] + moves[0, k], p[:, 1] + moves[1, k]) for k in (0, 1)], 1)
        else:
            forward[at] = e[at]
    for t in range(steps - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        q = backward[at + 1] + e[at + 1]
        backward[at] = np.stack([np.logaddexp(moves[k, 0] + q[:, 0], moves[k, 1] + q[:, 1]) for k in (0, 1)], 1)
    both = forward + backward
    z = np.logaddexp(both[:, 0], both[:, 1])
    expected = np.zeros((2, 2))
    inner = np.ones(total, bool)
    inner[np.cumsum(per_text) - per_text] = False
    here = np.nonzero(inner)[0]
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(forward[here - 1, a] + moves[a, b] + e[here, b] + backward[here, b] - z[here]).sum()
    return np.exp(both[:, 1] - z), expected, float(z[np.cumsum(per_text) - 1].sum())


def _fit_field(x: np.ndarray, y: np.ndarray, per_text: np.ndarray, rounds: int = 150, ridge: float = 1.0) -> tuple:
    """Weights and transitions of the greatest penalised likelihood, by gradient steps with adaptive rates (Adam)."""
    n = len(y)
    ones = np.hstack([x, np.ones((n, 1))])
    inner = np.ones(n, bool)
    inner[np.cumsum(per_text) - per_text] = False
    here = np.nonzero(inner)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1], y[here]), 1)
    theta = np.zeros(ones.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = marginals(ones @ w, per_text, moves)
        grad = np.concatenate([ones.T @ (y - good), (seen - expected).ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta += 0.1 * (1 - 0.9 * i / rounds) * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _share_good(good: np.ndarray, per_text: np.ndarray, chars: np.ndarray) -> np.ndarray:
    weight = chars + 1
    at = np.cumsum(per_text) - per_text
    return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_arrays(x: np.ndarray, per_text: np.ndarray, chars: np.ndarray, label: np.ndarray) -> Model:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    y = np.repeat(label, per_text)
    weights, moves = _fit_field(z, y, per_text)
    good = marginals(z @ weights[:-1] + weights[-1], per_text, moves)[0]
    fair = (good > 0.9) & (y == 0)  # a bad document's lines that look good, unless that is most of its text
    most = np.repeat(_share_good(fair.astype(float), per_text, chars) < 0.5, per_text)
    weights, moves = _fit_field(z, np.where(fair & most, 1, y), per_text)
    good = marginals(z @ weights[:-1] + weights[-1], per_text, moves)[0]
    share = _logit(_share_good(good, per_text, chars))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one input, lightly penalised
        p = 1 / (1 + np.exp(-(slope * share + shift)))
        h = p * (1 - p)
        g = np.array([((label - p) * share).sum() - 0.1 * (slope - 1), (label - p).sum() - 0.1 * shift])
        a = np.array([[(h * share * share).sum() + 0.1, (h * share).sum()], [(h * share).sum(), h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(a, g), -1, 1)
        slope, shift = slope + step[0], shift + step[1]
    return Model(mean, scale, weights, moves, max(slope, 0.01), shift)


def score_texts(texts: list[str], model: Model | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    out, at = [], 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= CHUNK:
            size += len(texts[stop])
            stop += 1
        x, per_text, chars = line_features(texts[at:stop])
        z = np.clip((x - model.mean) / model.scale, -8, 8)
        good = marginals(z @ model.weights[:-1] + model.weights[-1], per_text, model.moves)[0]
        share = _logit(_share_good(good, per_text, chars))
        out.append(1 / (1 + np.exp(-np.clip(model.slope * share + model.shift, -500, 500))))
        at = stop
    return np.concatenate(out)


_LINES = "label int, lines int, features binary, chars binary"


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = MOST,
        most_lines: int = MOST_LINES) -> Model | None:
    """A model from a bounded sample of labelled documents; ``labels`` are the rows that may be learned from."""
    chosen = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
              .orderBy(F.xxhash64("_key"), "_key").limit(most))
    rows = (docs.select(F.col(key).alias("_key"), whole().alias("text")).join(F.broadcast(chosen), "_key")
            .where(F.size(F.split("text", "\n")) <= most_lines).select("_label", "text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for y, text in zip(batch["_label"], batch["text"]):
                x, per_text, chars = line_features([text])
                found.append((int(y), int(per_text[0]), x.astype("<f4").tobytes(), chars.astype("<f4").tobytes()))
            yield pd.DataFrame(found, columns=["label", "lines", "features", "chars"])

    got = sorted(rows.mapInPandas(features, _LINES).limit(2 * most).collect(), key=lambda r: (r.label, bytes(r.features)))
    y = np.array([r.label for r in got])
    if len(set(y.tolist())) < 2:
        return None
    per_text = np.array([r.lines for r in got])
    chars = np.concatenate([np.frombuffer(r.chars, "<f4") for r in got]).astype(float)
    x = np.concatenate([np.frombuffer(r.features, "<f4") for r in got]).astype(float).reshape(len(chars), -1)
    return fit_arrays(x, per_text, chars, y)


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """``docs`` with the quality of every text."""

    @F.pandas_udf(T.DoubleType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score_texts(batch.tolist(), model))

    return docs.withColumn(out, apply(whole()))


#: A document is kept from this score on.
KEEP = 0.3


def held_out(key: str = "doc_id"):
    """Whether a document's label is kept from learning: one in five by a digest of its id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
