import random

import __spark_entry__ as contract
import numpy as np
import pytest
from helpers import SF, components, odd, shingle_set, texts_of
from tidemark.llm import bitmaps
from tidemark.llm import ngram_join as join


def test_query(spark):
    texts = texts_of(spark)
    want = components(texts)
    for r in contract.queries()["op4_ngram_join"](spark, SF).collect():
        assert (r.n_shingles, r.component_id) == (len(shingle_set(texts[r.doc_id])), want[r.doc_id])


@pytest.fixture(scope="module")
def crowd():
    rand = random.Random(3)
    v = [f"w{i}" for i in range(3000)]
    passage = [rand.choice(v) for _ in range(60)]
    docs = [[rand.choice(v) for _ in range(rand.choice([20, 80, 150]))] + passage + [rand.choice(v) for _ in range(30)] for _ in range(60)]
    base = [rand.choice(v) for _ in range(200)]
    for _ in range(80):
        near = list(base)
        for _ in range(rand.choice([0, 1, 2, 4, 8, 12])):
            near[rand.randrange(200)] = rand.choice(v)
        docs.append(near)
    chain = [rand.choice(v) for _ in range(100)]
    for _ in range(30):
        at = rand.randrange(94)
        chain = chain[:at] + [rand.choice(v) for _ in range(4)] + chain[at + 4:]
        docs.append(chain[:rand.choice([90, 95, 100])])
    docs += [["a", "b"], ["A", "b"], [], []] + [passage + [rand.choice(v) for _ in range(k)] for k in range(20)]
    return {i: " ".join(d) for i, d in enumerate(docs)}


@pytest.mark.parametrize("often, most", [(32, 200_000), (2, 200_000), (2, 20), (10**9, 1)])
def test_brute_force(spark, crowd, monkeypatch, often, most):
    monkeypatch.setattr(join, "OFTEN", often)
    monkeypatch.setattr(join, "MOST_HOT", most)
    want = components(crowd)
    df = spark.createDataFrame(list(crowd.items()) + [(0, crowd[0])], "doc_id long, text string").repartition(7)
    got = join.join(df).collect()
    assert len(got) == len(crowd) + 1
    assert {r.doc_id: r.component_id for r in got} == want


def test_odd_rows(spark):
    got = join.join(odd(spark)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got if r.doc_id not in (5, 6)) == sorted(
        [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 0, "4"), ("None", 0, "None"), ("None", 1, "None")])
    assert join.join(odd(spark).limit(0)).count() == 0


def test_bitmap_bound():
    rand = np.random.default_rng(1)
    for _ in range(200):
        pool = rand.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rand.choice(pool, rand.integers(1, 300))) for _ in range(2))
        apart = int(np.bitwise_count((join.bitmap(a) ^ join.bitmap(b)).view(np.uint64)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) / 2


def test_filter_lets_members_through(spark):
    values = list(range(-500, 500, 7)) + [2**62, -2**63]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    bits = bitmaps.of_column(df, "v")
    assert bitmaps.holds(bits, np.array(values)).all()
    assert bitmaps.holds(bits, np.arange(10_000, 20_000)).sum() == 0


def test_counting_holds_its_sets_and_one_copy():
    import tracemalloc

    rand = np.random.default_rng(5)
    sets = [np.unique(rand.integers(0, 400_000, 400, dtype=np.uint64)) for _ in range(2_500)]
    keys, many = np.unique(np.concatenate(sets), return_counts=True)
    size = sum(s.nbytes for s in sets)
    tracemalloc.start()
    got, times = join.thrice(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == keys[many >= 3]).all() and (times == many[many >= 3]).all() and sets == []
    assert peak < 3 * size
    assert [len(x) for x in join.thrice([np.array([], np.uint64)])] == [0, 0]


def test_sets_met_before_are_not_made_again():
    import pyarrow as pa
    import zstandard

    sets = join._Sets()
    text = pa.scalar(zstandard.ZstdCompressor().compress(b"a b c d e f g"), pa.binary())
    first = sets.of(1, text)
    assert sets.of(1, text) is first and len(first) == 3
    sets.most = 4
    assert len(sets.of(2, text)) == 3 and list(sets) == [2]


def test_bitmaps_tell_large_sets_apart():
    rand = np.random.default_rng(2)
    pool = rand.integers(0, 2**63, 6000, dtype=np.uint64)
    a, b = np.unique(pool[:4000]), np.unique(pool[2000:])
    p, q = (join.bitmap(s).view(np.uint64) for s in (a, b))
    bound = (len(a) + len(b) - int(np.bitwise_count(p ^ q).sum())) / 2
    assert 2000 <= bound < 3429  # the overlap, and what a link needs
    half = len(p) // 2
    bits = np.bincount((a & np.uint64(64 * half - 1)).astype(int), minlength=64 * half) & 1
    assert ((p[:half] ^ p[half:]) == np.packbits(bits.astype(np.uint8)).view(np.uint64)).all()


def test_unlinked_members_of_a_crowd_make_few_pairs(spark, monkeypatch):
    rand = random.Random(8)
    base = [f"b{i}" for i in range(150)]

    def near(edits):
        out = list(base)
        for at in rand.sample(range(3, 147, 6), edits):
            out[at] = f"e{rand.randrange(10**9)}"
        return " ".join(out)

    texts = {i: near(1) for i in range(150)} | {i: near(6) for i in range(150, 200)}
    made, whole_of = [], join.verified
    monkeypatch.setattr(join, "verified", lambda pairs, *rest: (made.append(pairs.count()), whole_of(pairs, *rest))[1])
    got = join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == components(texts)
    assert len({r.component_id for r in got}) == 51
    assert sum(made) < 1000  # of 50 * 150 pairs across


def test_sets_of_odd_texts():
    import pyarrow as pa
    from tidemark.llm.shingles import sets, split, words

    rand = random.Random(1)
    texts = ["", "a b", " \n\t ", "é▁漢😀 \x00 x", "A b C d E f", "a b c d e f", "x" * 100 + " y " + "X" * 100, "word " * 300, "  lead", "trail ",
             "a\x1cb c\x85d", "q" * 9 + " " + "q" * 8 + " " + "q" * 64 + " " + "q" * 65]
    texts += ["".join(rand.choice("aAbB \n\té\x0b") for _ in range(rand.randrange(60))) for _ in range(500)]
    known, made = {}, {}
    for part in (pa.array(texts), pa.array(texts).slice(3, 9), pa.array(texts, pa.large_string()), pa.array([""]), pa.array([], pa.string())):
        hashes, many = words(part)
        lists = [split(t) for t in part.to_pylist()]
        assert many.tolist() == [len(x) for x in lists]
        assert all(known.setdefault(w, h) == h for w, h in zip([w for x in lists for w in x], hashes.tolist()))
        for got, t in zip(sets(part), part.to_pylist()):
            want = shingle_set(t)
            assert len(got) == len(want) and (got[1:] > got[:-1]).all() and made.setdefault(want, got.tobytes()) == got.tobytes()
    assert len(set(known.values())) == len(known) and len(set(made.values())) == len(made)


def test_hashing_words_keeps_none_of_them():
    import tracemalloc

    import pyarrow as pa
    from tidemark.llm.shingles import sets

    texts = pa.array([" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, 100_000, 1000)])
    tracemalloc.start()
    size = sum(len(sets(texts.slice(at, 10))[0]) for at in range(0, 100, 10))
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size == 9960 and left < 1_000_000
