import itertools
import zlib

import __spark_entry__ as contract
import numpy as np
from helpers import SF, odd
from tidemark.llm import quality_crf as crf


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = contract.queries()["op10_quality_crf"](spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    per_text = np.array([3, 1, 4])
    emission, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    got, expected, z = crf.marginals(emission, per_text, moves)
    want, pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        states = list(itertools.product((0, 1), repeat=n))
        logs = np.array([sum(emission[at + i] * s[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(s, s[1:])) for s in states])
        p = np.exp(logs - np.logaddexp.reduce(logs))
        total += np.logaddexp.reduce(logs)
        want += [sum(q for q, s in zip(p, states) if s[i]) for i in range(n)]
        for q, s in zip(p, states):
            for a, b in zip(s, s[1:]):
                pairs[a, b] += q
        at += n
    assert np.allclose(got, want) and np.allclose(expected, pairs) and np.isclose(z, total)


def test_line_features():
    x, per_text, chars = crf.line_features(["Ab cd.\n\nxx xx xx", "", "12 | ab!!"])
    assert per_text.tolist() == [3, 1, 1] and chars.tolist() == [6, 0, 8, 0, 9]
    assert np.allclose(np.expm1(x[:, 0]), [2, 0, 3, 0, 3]) and np.allclose(x[2, 9], 2 / 3) and x[0, 11] == 1 and x[1, 12] == 1
    alone = crf.line_features(["12 | ab!!"])[0]
    assert np.allclose(alone[0], x[4])


def test_batches_do_not_matter(monkeypatch):
    texts = ["Some good text here.\nAnd more of it.", "BAD!! BAD!! BAD!!", "", "x | y | z |"] * 5
    x, per_text, chars = crf.line_features(texts)
    model = crf.fit_arrays(x, per_text, chars, np.array([1, 0, 1, 0] * 5))
    whole = crf.score_texts(texts, model)
    monkeypatch.setattr(crf, "CHUNK", 10)
    assert np.allclose(whole, crf.score_texts(texts, model))
    assert whole[0] > 0.5 > whole[1]


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (None, 1)], "doc_id long, quality int")
    got = crf.score(docs, crf.fit(docs, labels))
    assert got.columns == docs.columns and got.where("score between 0 and 1").count() == docs.count()
    assert crf.fit(docs, labels.limit(0)) is None and crf.score(docs, None).where("score = 0.5").count() == docs.count()
    assert crf.score(docs.limit(0), None).count() == 0
    assert contract.queries()["op10_quality_crf"](spark, SF).count() == 200
