"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors of the words of a shingle, by place.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Of eight bytes read at once, those that belong to a word with so many left.
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split()


def words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts without nulls, and how many each text has; words as ``split`` finds them."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    at -= at[0]
    low = np.zeros(size + 8, np.uint8)
    low[:size] = _LOWER[raw]
    within = ~_SPACE[raw]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < size)]
    first[edges] = within[edges]
    last[edges - 1] = within[edges - 1]
    begin, n = np.flatnonzero(first), np.flatnonzero(last) + 1
    n -= begin
    eight = np.ndarray(size + 1, "<u8", low, strides=(1,))
    out = mix(n.astype(np.uint64) * _STEP + (eight[begin] & _PART[np.minimum(n, 8)]))
    more, done = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(more):
        out[more] = mix(out[more] * _STEP + (eight[begin[more] + done] & _PART[np.minimum(n[more] - done, 8)]))
        done += 8
        more = more[n[more] > done]
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(low[begin[i]:begin[i] + n[i]])
    return out, np.diff(np.searchsorted(begin, at))


def sets(texts: pa.StringArray) -> list[np.ndarray]:
    """The set of every text: the hashes of all its runs of ``WIDTH`` words, or of its whole sequence where it is shorter."""
    hashes, many = words(texts)
    every = np.zeros_like(hashes)
    full = every[:max(len(hashes) - WIDTH + 1, 0)]
    for j, factor in enumerate(_FACTORS):
        full += hashes[j:j + len(full)] * factor
    every = mix(every + np.uint64(WIDTH))
    at = np.cumsum(many) - many
    size = np.where(many >= WIDTH, many - WIDTH + 1, np.minimum(many, 1))
    for i in np.flatnonzero((many > 0) & (many < WIDTH)).tolist():
        own = hashes[at[i]:at[i] + many[i]]
        every[at[i]] = mix((own * _FACTORS[:len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    for a, n in zip(at.tolist(), size.tolist()):
        every[a:a + n].sort()
    keep = np.arange(len(every)) - np.repeat(at, many) < np.repeat(size, many)
    fresh = keep.copy()
    fresh[1:] &= every[1:] != every[:-1]
    fresh[at[many > 0]] = True
    ends = np.concatenate([[0], np.cumsum(fresh)])
    every = every[fresh]
    return [every[a:b] for a, b in zip(ends[at].tolist(), ends[at + many].tolist())]
