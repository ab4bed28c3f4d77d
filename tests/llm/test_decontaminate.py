import random

import numpy as np
import pyarrow as pa

import __spark_entry__ as contract
from helpers import SF, odd, shingle_set, texts_of
from tidemark.llm.decontaminate import Items, Runs, Weights, _hashes, find_leaks


def bench(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def test_query(spark):
    """Every document that holds a whole item is found; what is found shares most of the item's shingles."""
    texts, items = texts_of(spark), bench(spark)
    got = {(r.doc_id, r.item_id) for r in contract.queries()["op9_decontaminate"](spark, SF).collect()}
    for i, t in texts.items():
        have = shingle_set(t)
        for k, item in items.items():
            want = shingle_set(item)
            share = len(want & have) / len(want)
            if share == 1:
                assert (i, k) in got
            if share < 0.6:
                assert (i, k) not in got


def test_edited_copies(spark):
    items = bench(spark)
    search = Items(list(items), list(items.values()))
    rand = random.Random(1)
    clean = [t for t, found in zip(texts_of(spark).values(), search.find(list(texts_of(spark).values()))) if not found]
    texts, truth = [], []
    for _ in range(600):
        k, item = rand.choice(list(items.items()))
        words, edits = item.split(), rand.choice([0, 1, 2])
        for _ in range(edits):
            words[rand.randrange(len(words))] = "changed"
        host = rand.choice(clean).split()
        at = rand.randrange(len(host) + 1)
        texts.append(" ".join(host[:at] + words + host[at:]))
        want = shingle_set(item)
        truth.append((k, edits, len(want & shingle_set(" ".join(words))) / len(want) >= 0.8))
    found = search.find(texts)
    hits = [any(f[0] == k for f in own) for own, (k, _, _) in zip(found, truth)]
    assert all(h for h, (_, edits, _) in zip(hits, truth) if not edits)
    near = [h for h, (_, edits, like) in zip(hits, truth) if edits and like]
    assert sum(near) >= 0.9 * len(near)


def test_lengths_and_places():
    rand = random.Random(3)
    word = lambda: "".join(rand.choice("abcdefghij") for _ in range(5))
    for m in [1, 3, 5, 9, 14, 15, 16, 40, 90, 700]:
        item = " ".join(word() for _ in range(m))
        search = Items([7], [item])
        for lead in range(6):
            text = " ".join([word() for _ in range(lead)] + [item.upper()] + [word() for _ in range(3)])
            assert [(f[0], f[1]) for f in search.find([text, word(), ""])[0]] == [(7, lead)], (m, lead)
        assert search.find([word()]) == [[]]


def test_odd_rows(spark):
    docs = odd(spark, "leaks double, item_id string, start int")
    items = spark.createDataFrame([(1, "one two three. Four five six."), (2, None), (3, ""), (None, "x"), (1, "one two three. Four five six.")],
                                  "item_id long, text string")
    got = find_leaks(docs, items)
    assert got.count() == docs.count() and got.columns == docs.columns
    assert got.where("size(leaks) > 0").count() == 2
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_edited_copies_of_every_length():
    """Every copy of three quarters of an item's shingles is found, at any length, place and choice of edits."""
    rand = random.Random(12)
    word = lambda: "".join(rand.choice("abcdefghij") for _ in range(5))
    edited = 0
    for m in [*range(1, 61), 100, 300]:
        item = [word() for _ in range(m)]
        search, want = Items([7], [" ".join(item)]), shingle_set(" ".join(item))
        for _ in range(40):
            copy, at = list(item), rand.randrange(m)
            spots = rand.choice([[at], [at, (at + 1) % m], [at, rand.randrange(m)], [0], [0, m - 1]])
            for k in spots:
                copy[k] = "changed"
            if len(want & shingle_set(" ".join(copy))) < 0.75 * len(want):
                continue
            edited += 1
            lead = [word() for _ in range(rand.randrange(9))]
            found = search.find(["", " ".join(lead + copy + [word() for _ in range(rand.randrange(9))]), word()])
            assert [[f[0] for f in own] for own in found] == [[], [7], []], (m, spots)
    assert edited > 1000


def test_leaks_are_found_once(spark):
    plan = contract.queries()["op9_decontaminate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sums_of_windows():
    rows = np.random.default_rng(5).integers(0, 13, (40, 64)).astype(np.int16)
    runs = Runs(rows)
    for length in (1, 2, 3, 4, 5, 7, 13, 31, 32, 40):
        assert (runs.of(length) == [rows[i:i + length].sum(axis=0) for i in range(41 - length)]).all()


def test_weights_of_words():
    """A word of over a tenth of the texts weighs 1, over a fiftieth 2, others and words of one text 3."""
    texts = [" ".join(w for w, every in (("a", 2), ("b", 25), ("c", 100)) if i % every == 0) + f" own{i}" for i in range(100)]
    weights = Weights(_hashes(pa.array(texts)))
    (found,) = _hashes(pa.array(["a b C A own3 new"]))
    assert (weights.of(found) & np.uint64(3)).tolist() == [1, 2, 3, 1, 3, 3]
    assert (weights.of(found) >> np.uint64(2) == found >> np.uint64(2)).all()


def test_far_items_are_not_aligned(spark):
    """Fingerprints may be near by chance; only pairs whose shared shingles can weigh enough are aligned, and none is lost by that."""
    texts = list(texts_of(spark).values())
    items = bench(spark)
    tried = []

    class Seen(Items):
        def _similarity(self, item, doc, start, slack):
            like = super()._similarity(item, doc, start, slack)
            tried.append((item, doc.tobytes(), slack, like))
            return like

    found = Seen(list(items), list(items.values())).find(texts)
    pairs = {(i, d) for i, d, *_ in tried}
    kept = {(i, d) for i, d, slack, like in tried if slack and like >= 0.75}
    assert sum(map(len, found)) >= len(kept) >= 0.8 * len(pairs) > 0
