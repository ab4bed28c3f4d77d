"""Sampled segmentations of texts into SentencePiece pieces, without replacement, and decoding.

A text's lattice has a node before every character and an edge for every piece; a character that is no piece has an edge of
its UTF-8 byte pieces. Pieces do not cross the start of a word, so lattices are built once per distinct word. A piece's
weight follows its rank in the vocabulary (Zipf's law, ``alpha`` sharpens or flattens it), and backward sums over the
lattice give the exact chance of every edge from its node on.

Samples come from a perturbed best-first (A*) search over the tree of prefixes. Every subtree's value is the maximum of
Gumbel-perturbed log chances of the segmentations below it, which is itself a Gumbel variable at the subtree's log chance;
children get values conditioned on their maximum being their parent's. The search expands the subtree of the largest value,
so segmentations leave it in falling order of value: a sample without replacement. The siblings along a path stay one
subtree until one of them is expanded. The value of the best subtree left over is the threshold of the inclusion scores.

Random numbers are a function of the row's key, the sample, the word and the step, so a row's samples do not depend on how
rows are placed. Repeated rows get the same samples.

Defined results: null texts count as empty; the empty text has one segmentation, of no pieces; a text with fewer
segmentations than asked gives them all, with inclusion 1; rows without a key are seeded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, whole
from tidemark.llm.shingles import mix

_UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Words looked at together, and lattice nodes that a worker keeps.
CHUNK, NODES = 80_000, 1_000_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def model_bytes(path: str) -> bytes:
    """The vocabulary's file, read once by the driver and lent to the tasks (it has a fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def _piece(sp, i: int) -> tuple[str | None, bytes]:
    """A piece as text, if it is one, and as bytes."""
    piece = sp.id_to_piece(i)
    if sp.is_byte(i):
        return None, bytes([int(piece[1:-1], 16)])
    if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
        return None, b""
    text = piece.replace("▁", " ")
    return text, text.encode()


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def raw_pieces(model: bytes) -> list[bytes]:
    """The bytes of every piece."""
    sp = _processor(model)
    return [_piece(sp, i)[1] for i in range(sp.vocab_size())]


class Vocabulary:
    """Pieces, their weights, and per length the hashes of all prefixes of pieces."""

    def __init__(self, model: bytes, alpha: float):
        sp = _processor(model)
        self.size = sp.vocab_size()
        self.weight = -alpha * np.log(np.arange(self.size) + 2.0)
        self.byte = np.full(256, -1, np.int64)
        self.raw: list[bytes] = []
        prefixes: dict[str, int] = {}
        for i in range(self.size):
            text, raw = _piece(sp, i)
            self.raw.append(raw)
            if text is not None:
                for n in range(1, len(text)):
                    prefixes.setdefault(text[:n], -1)
                prefixes[text] = i
            elif raw:
                self.byte[raw[0]] = i
        self.byte_weight = -alpha * math.log(self.size + 2.0)
        self.tables = []
        by_length: dict[int, list] = {}
        for text, i in prefixes.items():
            by_length.setdefault(len(text), []).append((text, i))
        for n in sorted(by_length):
            h = np.zeros(len(by_length[n]), np.uint64)
            codes = np.frombuffer("".join(t for t, _ in by_length[n]).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
            for j in range(n):
                h = extend(h, codes[:, j])
            order = np.argsort(h)
            self.tables.append((h[order], np.array([i for _, i in by_length[n]])[order]))


def extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + code + np.uint64(1)


class Numbers(dict):
    """Numbers of words in the order of their coming; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


class Lattices:
    """Lattices of words, one after another: nodes, and the edges of each node with running chances."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.start = np.zeros(0, np.int32)  # per word its first node
        self.stop = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)  # per node its first edge, and one past the last
        self.to = np.zeros(0, np.int32)
        self.token = np.zeros(0, np.int32)
        self.upto = np.zeros(0)  # running chance of a node's edges
        self.log = np.zeros(0)

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of words; lattices of new words are added."""
        if len(self.first) > NODES:
            self.clear()
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._add(self.index.new)
            self.index.new = []
        return out

    def _add(self, words: list[str]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(codes)
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        left = ends[word] - np.arange(n)  # characters to the word's end
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        found = []
        single = np.zeros(n, bool)
        for size, (hashes, pieces) in enumerate(self.v.tables, 1):
            keep = left[alive] >= size
            alive, h = alive[keep], h[keep]
            if not len(alive):
                break
            h = extend(h, codes[alive + size - 1])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            alive, h, piece = alive[hit], h[hit], pieces[at[hit]]
            good = piece >= 0
            found.append((alive[good], size, piece[good], self.v.weight[piece[good]]))
            if size == 1:
                single[alive[good]] = True
        rest = np.nonzero(~single)[0]
        c = codes[rest].astype(np.int64)
        many = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        found.append((rest, 1, np.where(c < 0x80, self.v.byte[np.minimum(c, 127)], self.v.size + c), many * self.v.byte_weight))
        # edges in the order of their nodes, long pieces first, which are the likelier ones
        degree = sum(np.bincount(f[0], minlength=n) for f in found)
        first = np.concatenate([[0], np.cumsum(degree)])
        filled = first[:-1].copy()
        to, token, weight = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int32), np.zeros(first[-1])
        for nodes, size, pieces, weights in reversed(found):
            at = filled[nodes]
            to[at], token[at], weight[at] = nodes + size, pieces, weights
            filled[nodes] += 1
        # sums of the chances behind each node, from the ends of the words to their starts
        behind = np.zeros(n + 1)
        ending = np.repeat(ends, lengths)
        order = np.argsort(left, kind="stable")
        cut = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        value = np.zeros(first[-1])
        for d in range(len(cut) - 1):
            nodes = order[cut[d]:cut[d + 1]]
            if not len(nodes):
                continue
            deg = degree[nodes]
            lead = np.cumsum(deg) - deg
            edge = np.repeat(first[nodes] - lead, deg) + np.arange(int(deg.sum()))
            target = to[edge]
            val = weight[edge] + np.where(target == np.repeat(ending[nodes], deg), 0.0, behind[np.minimum(target, n)])
            top = np.maximum.reduceat(val, lead)
            behind[nodes] = top + np.log(np.add.reduceat(np.exp(val - np.repeat(top, deg)), lead))
            value[edge] = val
        source = np.repeat(np.arange(n), degree)
        log = value - behind[source]
        chance = np.exp(log)
        upto = np.cumsum(chance)
        upto -= (upto - chance)[first[:-1]][source]
        upto[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        # nodes of all words are numbered on, each word followed by its end
        base, edges = len(self.first) - 1, len(self.to)
        shift = base + np.arange(len(words))
        starts = ends - lengths + shift
        self.start = np.concatenate([self.start, starts.astype(np.int32)])
        self.stop = np.concatenate([self.stop, (starts + lengths).astype(np.int32)])
        per_node = np.insert(degree, ends, 0)
        self.first = np.concatenate([self.first, edges + np.cumsum(per_node)])
        self.to = np.concatenate([self.to, (to + shift[word[source]]).astype(np.int32)])
        self.token = np.concatenate([self.token, token])
        self.upto = np.concatenate([self.upto, upto])
        self.log = np.concatenate([self.log, log])


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers above 0 and below 1, by seed and step."""
    with np.errstate(over="ignore"):
        x = mix(seeds + np.uint64(step + 1) * _SEED)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def draw(lat: Lattices, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation of each word by the lattice's chances: edges of all words in order, edges per word."""
    at, stop = lat.start[words].astype(np.int64), lat.stop[words]
    active = np.arange(len(words))
    steps, owners = [], []
    step = 0
    while len(active):
        u = uniform(seeds[active], step)
        edge = lat.first[at[active]]
        more = np.nonzero(u > lat.upto[edge])[0]
        while len(more):
            edge[more] += 1
            more = more[u[more] > lat.upto[edge[more]]]
        steps.append(edge)
        owners.append(active)
        at[active] = lat.to[edge]
        active = active[at[active] < stop[active]]
        step += 1
    count = np.zeros(len(words), np.int64)
    for o in owners:
        count[o] += 1
    out = np.zeros(int(count.sum()), np.int64)
    begin = np.cumsum(count) - count
    for s, (edge, o) in enumerate(zip(steps, owners)):
        out[begin[o] + s] = edge
    return out, count


def gumbel_below(location: np.ndarray, most: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at their locations, given that they are below ``most``."""
    with np.errstate(over="ignore", divide="ignore"):
        return location - np.log(np.exp(location - most) - np.log(u))


_MASK = 2**64 - 1


class Path:
    """A segmentation: its edges with their log chances, edges per word, and its perturbed value."""

    __slots__ = ("edges", "counts", "log", "value", "kept", "before", "seed")

    def __init__(self, edges: np.ndarray, counts: np.ndarray, log: np.ndarray, value: float, kept: int, before: float, seed: int):
        """Siblings from step ``kept`` on belong to this path; ``before``: log chance up to there."""
        self.edges, self.counts, self.log, self.value, self.seed = edges, counts, log, value, seed & _MASK
        self.kept, self.before = kept, before


def best_siblings(paths: list[Path], most: int) -> list[list[tuple[float, int, float]]]:
    """Per path its ``most`` best sibling subtrees: (value, step, log chance before the step)."""
    out: list[list] = [[] for _ in paths]
    some = [i for i, p in enumerate(paths) if len(p.log) > p.kept]
    if not some:
        return out
    size = np.array([len(paths[i].log) - paths[i].kept for i in some])
    log = np.concatenate([paths[i].log[paths[i].kept:] for i in some])
    begin = np.cumsum(size) - size
    summed = np.cumsum(log)
    lead = np.array([paths[i].before for i in some]) - (summed - log)[begin]
    prefix = summed - log + np.repeat(lead, size)
    step = np.arange(len(log)) - np.repeat(begin, size) + np.repeat([paths[i].kept for i in some], size)
    seeds = np.repeat(np.array([paths[i].seed for i in some], np.uint64), size) + step.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    rest = -np.expm1(log)
    with np.errstate(divide="ignore"):
        location = prefix + np.where(rest > 1e-15, np.log(rest), -np.inf)
    value = gumbel_below(location, np.repeat([paths[i].value for i in some], size), uniform(seeds, 7))
    for _ in range(most):
        top = np.maximum.reduceat(value, begin)
        at = np.nonzero((value == np.repeat(top, size)) & (value > -np.inf))[0]
        owner = np.searchsorted(begin, at, "right") - 1
        owner, first = np.unique(owner, return_index=True)
        at = at[first]
        for o, v, t, b in zip(owner.tolist(), value[at].tolist(), step[at].tolist(), prefix[at].tolist()):
            out[some[o]].append((v, t, b))
        value[at] = -np.inf
    return out


class Search:
    """The samples of one text."""

    def __init__(self, lat: Lattices, words: np.ndarray, draws: list[tuple[np.ndarray, np.ndarray]], key: int):
        """``draws``: a segmentation of every word for each sample."""
        self.lat, self.words, self.draws, self.key = lat, words, draws, key
        edges, counts = draws[0]
        top = -math.log(-math.log(float(uniform(np.array([key], np.uint64), 0)[0])))
        self.paths = [Path(edges, counts, lat.log[edges], top, 0, 0.0, key + 1)]
        self.heap: list = []
        self.taken: dict[tuple, set] = {}  # edges already expanded at a node of the prefix tree

    def add(self, path: int, siblings: list[tuple[float, int, float]]) -> None:
        for value, step, before in siblings:
            heapq.heappush(self.heap, (-value, step, path, before))

    def expand(self) -> Path | None:
        """Takes the best subtree and makes its best segmentation the next sample."""
        if not self.heap:
            return None
        lat, j = self.lat, len(self.paths)
        value, step, parent, before = heapq.heappop(self.heap)
        value, path = -value, self.paths[parent]
        node_edge = int(path.edges[step])
        node = int(np.searchsorted(lat.first, node_edge, "right")) - 1
        block = self.taken.setdefault((parent, step), {node_edge})
        free = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in block]
        weights = np.exp(lat.log[free])
        seed = (self.key + 1000003 * j) & _MASK
        u = uniform(np.array([seed], np.uint64), 3)[0] * weights.sum()
        edge = free[min(int(np.searchsorted(np.cumsum(weights), u)), len(free) - 1)]
        block.add(edge)
        left = float(weights.sum() - math.exp(lat.log[edge]))
        if len(free) > 1 and left > 0:
            again = gumbel_below(np.array([before + math.log(left)]), value, uniform(np.array([seed], np.uint64), 4))
            heapq.heappush(self.heap, (-float(again[0]), step, parent, before))
        # the rest of the word from the new edge on, then this sample's own draw of the words behind
        word = int(np.searchsorted(np.cumsum(path.counts), step, "right"))
        tail, at, s, stop = [edge], int(lat.to[edge]), 5, int(lat.stop[self.words[word]])
        while at < stop:
            e = int(lat.first[at])
            r = uniform(np.array([seed], np.uint64), s)[0]
            while r > lat.upto[e]:
                e += 1
            tail.append(e)
            at, s = int(lat.to[e]), s + 1
        own, counts = self.draws[j]
        joined = np.concatenate([path.edges[:step], np.array(tail, np.int64), own[int(counts[:word + 1].sum()):]])
        per_word = np.concatenate([path.counts[:word], [step - int(path.counts[:word].sum()) + len(tail)], counts[word + 1:]])
        log = lat.log[joined]
        self.paths.append(Path(joined, per_word, log, value, step + 1, before + float(log[step]), seed + 17))
        return self.paths[-1]

    def left(self) -> float:
        """Value of the best subtree left."""
        return -self.heap[0][0] if self.heap else -math.inf


def _inclusion(log: float, left: float) -> float:
    """Log of the chance that a segmentation is among the samples, given the value of the best subtree left."""
    x = log - left
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


class Sampler:
    def __init__(self, model: bytes, k: int, alpha: float = 1.0):
        self.v, self.k = Vocabulary(model, alpha), k
        self.lattices = Lattices(self.v)

    def encode(self, texts: list[str], keys: list[int]) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
        """(row, sample, piece ids, log chance, log inclusion) of every sample of every text."""
        rows: list[int] = []
        words: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            rows.append(i)
            words.append(_UNIT.findall(" " + text) if text else [])
            size += len(words[-1])
            if size >= CHUNK or i == len(texts) - 1:
                yield from self._encode(rows, words, [keys[r] for r in rows])
                rows, words, size = [], [], 0

    def _encode(self, rows, words, keys):
        lat = self.lattices
        many = np.array([len(w) for w in words])
        ids = lat.ids([u for w in words for u in w])
        ends = np.cumsum(many)
        place = np.arange(len(ids)) - np.repeat(ends - many, many)
        seeds = mix(np.repeat(np.array([k & _MASK for k in keys], np.uint64), many) + place.astype(np.uint64) * _SEED)
        draws = []
        for j in range(self.k):
            edges, counts = draw(lat, ids, mix(seeds + np.uint64(j * 2 + 1)))
            draws.append((edges, counts, np.concatenate([[0], np.cumsum(counts)])))
        found = []
        for key, stop, n in zip(keys, ends.tolist(), many.tolist()):
            a = stop - n
            own = [(edges[at[a]:at[stop]], counts[a:stop]) for edges, counts, at in draws]
            found.append(Search(lat, ids[a:stop], own, key & _MASK))
        fresh = [(x, x.paths[0]) for x in found]
        for j in range(self.k):
            for (x, _), siblings in zip(fresh, best_siblings([p for _, p in fresh], self.k - j)):
                x.add(j, siblings)
            if j < self.k - 1:
                fresh = [(x, p) for x, _ in fresh if (p := x.expand()) is not None]
        for r, x in zip(rows, found):
            left = x.left()
            for j, p in enumerate(x.paths):
                log = float(p.log.sum())
                yield r, j, self._tokens(lat.token[p.edges]), log, _inclusion(log, left)

    def _tokens(self, tokens: np.ndarray) -> np.ndarray:
        """Ids, with the byte pieces of characters that are no pieces."""
        odd = np.nonzero(tokens >= self.v.size)[0]
        if not len(odd):
            return tokens
        parts, last = [], 0
        for i in odd.tolist():
            data = chr(int(tokens[i]) - self.v.size).encode("utf-8", "surrogatepass")
            parts += [tokens[last:i], self.v.byte[np.frombuffer(data, np.uint8)].astype(np.int32)]
            last = i + 1
        return np.concatenate([*parts, tokens[last:]])


def decode_ids(ids, raw: list[bytes]) -> str:
    """Text of piece ids; ``raw``: the bytes of every piece."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _coded(batches: Iterator[pa.RecordBatch], lent, k: int, alpha: float) -> Iterator[pa.RecordBatch]:
    sampler = _sampler(lent, k, alpha)
    for batch in slices(batches):
        taken, samples, ids, logs, inclusions = [], [], [], [], []
        for row, j, tokens, log, inclusion in sampler.encode(batch.column("_text").to_pylist(), batch.column("_key").to_pylist()):
            taken.append(row)
            samples.append(j)
            ids.append(tokens)
            logs.append(log)
            inclusions.append(inclusion)
        yield _batch(batch, taken, samples, ids, logs, inclusions)


def _run(docs: DataFrame, model: bytes, k: int, key: str, keep: tuple[str, ...], alpha: float, then, columns: str) -> DataFrame:
    lent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in keep], whole().alias("_text"), F.xxhash64(key).alias("_key"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-2])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(_coded(batches, lent, k, alpha), lent)

    return rows.mapInArrow(apply, kept + columns)


def encode(docs: DataFrame, model: bytes, k: int = 2, key: str = "doc_id", keep: tuple[str, ...] = (), alpha: float = 1.0) -> DataFrame:
    """Rows (``keep`` columns, sample, ids, log_prob, log_inclusion): up to k segmentations of each text."""
    return _run(docs, model, k, key, keep, alpha, lambda coded, _: coded,
                "sample int, ids array<int>, log_prob double, log_inclusion double")


def encode_digests(docs: DataFrame, model: bytes, k: int = 2, key: str = "doc_id", keep: tuple[str, ...] = (),
                   alpha: float = 1.0) -> DataFrame:
    """The same with digests in place of the ids: their number, the SHA-256 of the ids (as 32-bit numbers, low byte
    first), and that of the text they decode to."""
    return _run(docs, model, k, key, keep, alpha, _digested, "sample int, n_pieces int, ids_sha256 string, decoded_sha256 string, "
                "log_prob double, log_inclusion double")


def _digested(coded: Iterator[pa.RecordBatch], lent) -> Iterator[pa.RecordBatch]:
    raw = raw_pieces(lent.value)
    for batch in coded:
        ids, own = batch.column("ids"), []
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        for a, b in zip(ends, ends[1:]):
            part = flat[a:b]
            own.append((len(part), hashlib.sha256(part.astype("<i4").tobytes()).hexdigest(),
                        hashlib.sha256(decode_ids(part.tolist(), raw).encode()).hexdigest()))
        n, code, text = zip(*own) if own else ((), (), ())
        names = [x for x in batch.schema.names if x != "ids"]
        at = names.index("sample") + 1
        columns = [batch.column(x) for x in names]
        columns[at:at] = [pa.array(n, pa.int32()), pa.array(code, pa.string()), pa.array(text, pa.string())]
        names[at:at] = ["n_pieces", "ids_sha256", "decoded_sha256"]
        yield pa.RecordBatch.from_arrays(columns, names)


def _batch(batch: pa.RecordBatch, taken, samples, ids, logs, inclusions) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    names = [n for n in batch.schema.names if n not in ("_text", "_key")]
    columns = [batch.column(n).take(pa.array(taken, pa.int64())) for n in names]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(samples, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
         pa.array(logs, pa.float64()), pa.array(inclusions, pa.float64())],
        [*names, "sample", "ids", "log_prob", "log_inclusion"])


_kept: dict = {}


def _sampler(lent, k: int, alpha: float) -> Sampler:
    """One per worker process, so that lattices of common words are built once."""
    name = (hashlib.sha256(lent.value).digest(), k, alpha)
    if name not in _kept:
        _kept.clear()
        _kept[name] = Sampler(lent.value, k, alpha)
    return _kept[name]


def decode(coded: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """``coded`` with the text of its piece ids."""
    lent = coded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = raw_pieces(lent.value)
        for batch in batches:
            yield pd.Series([decode_ids(x, raw) for x in batch], dtype=object)

    return coded.withColumn(out, apply(ids))

