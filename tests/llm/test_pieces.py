import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, odd, texts_of
from tidemark.llm import pieces
from tidemark.llm.common import whole
from tidemark.llm.pieces import Sampler, decode_ids, encode, model_bytes
import __spark_entry__ as contract


@pytest.fixture(scope="module")
def model():
    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def segmentations(text, v):
    """All segmentations with their log chances."""
    known = {r.decode(): i for i, r in enumerate(v.raw) if r and i not in set(v.byte.tolist())}
    out = []

    def go(at, ids, weight):
        if at == len(text):
            out.append((tuple(ids), weight))
            return
        for n in range(1, 17):
            piece = text[at:at + n]
            if len(piece) == n and piece in known:
                go(at + n, ids + [known[piece]], weight + v.weight[known[piece]])
        if text[at] not in known:
            raw = text[at].encode()
            go(at + 1, ids + [int(v.byte[b]) for b in raw], weight + len(raw) * v.byte_weight)

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {i: w - total for i, w in out}


@pytest.mark.parametrize("text", ["the cat", "é▁x", "a", "  b", "", "ab\nc\n", "漢😀"])
def test_all_segmentations(model, text):
    sampler = Sampler(model, 8)
    rows = list(sampler.encode([text], [12345]))
    ids = [tuple(r[2].tolist()) for r in rows]
    assert len(set(ids)) == len(ids) and all(decode_ids(i, sampler.v.raw) == text for i in ids)
    if text and "\n" not in text:
        every = segmentations(" " + text, sampler.v)
        assert len(ids) == min(8, len(every))
        assert all(abs(every[i] - r[3]) < 1e-9 for i, r in zip(ids, rows))
        assert (len(every) > 8) or all(r[4] == 0 for r in rows)


def test_sampling_without_replacement(model):
    sampler, n = Sampler(model, 2, 0.25), 12000
    every = segmentations(" a cat", sampler.v)
    rand = random.Random(0)
    seen = [collections.Counter(), collections.Counter()]
    weight = collections.Counter()
    for _, j, ids, log, inclusion in sampler.encode(["a cat"] * n, [rand.getrandbits(64) - 2**63 for _ in range(n)]):
        seen[j][tuple(ids.tolist())] += 1
        weight[tuple(ids.tolist())] += 1 / math.exp(inclusion) / n
    for s, log in sorted(every.items(), key=lambda x: -x[1])[:4]:
        p = math.exp(log)
        second = sum(math.exp(q) * p / (1 - math.exp(q)) for t, q in every.items() if t != s)
        assert abs(seen[0][s] / n - p) < 0.02 and abs(seen[1][s] / n - second) < 0.02
        assert abs(weight[s] - 1) < 0.2  # inclusion scores make counts unbiased


def test_samples_follow_the_key(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [sorted((r.doc_id, r.sample, tuple(r.ids)) for r in encode(docs.repartition(n), model, keep=("doc_id",)).collect()) for n in (1, 5)]
    assert rows[0] == rows[1]


def test_query(spark):
    rows, texts = contract.queries()["op7_sampled_pieces"](spark, SF).collect(), texts_of(spark)
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == texts.keys()
    ids = {}
    for r in rows:
        assert ids.setdefault(r.doc_id, {}).setdefault(r.ids_sha256, r.sample) == r.sample


def test_decode_and_odd_rows(spark, model):
    docs = odd(spark, "sample string, ids int")
    coded = encode(docs.withColumn("was", whole()), model, keep=("was",))
    back = pieces.decode(coded, model)
    assert back.where("text <> was").count() == 0 and back.count() >= docs.count()
    assert encode(docs.limit(0), model).count() == 0
