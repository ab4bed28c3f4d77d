import math
import random
import re
from collections import Counter

from helpers import AZ, odd
from tidemark.llm import bag_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, top=20):
    """(item_id, rank, doc_id, score), by the formula alone."""
    bags = [(i, TERM.findall((t or "").translate(AZ))) for i, t in docs]
    bags = [(i, b, Counter(b)) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, b, tf in bags:
            m = 75 + 25 * len(b) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(AZ)) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_terms():
    rand = random.Random(1)
    for _ in range(300):
        text = "".join(rand.choice("aZ09é漢😀_-\x00\x7f\x80\x85  \n.ßİ@[`{/:") for _ in range(40))
        assert [t.decode() for t in bag_search.terms_of(text)] == TERM.findall(text.translate(AZ))


def test_brute_force(spark):
    rand = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["É", "漢", "Ab"]
    docs = [(i, " ".join(rand.choice(words) for _ in range(rand.randrange(0, 25)))) for i in range(300)]
    # a crowd of one bag in other orders, with other words than the items', and texts that end or begin alike
    docs += [(1000 + i, " ".join(rand.sample(["w1", "w2", "w3", f"x{i}"], 4))) for i in range(150)]
    docs += [(5000 - i, "w1 w2 w3 other") for i in range(60)] + [(7, "w5"), (7, "w5"), (None, "w1 w2 w3 y"), (9000, None), (9001, ".")]
    items = [(k, " ".join(rand.choice(words) for _ in range(rand.randrange(1, 9)))) for k in range(25)]
    items += [(100, "w1 w1 W1 w2"), (101, ""), (102, None), (103, "nowhere"), (104, "w1 w2 w3 x")]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    for top, most in ((20, 1000), (3, 10)):
        got = bag_search.search(left.repartition(7), right, top, most).collect()
        assert sorted(map(tuple, got)) == sorted(brute(docs, items, top), key=lambda r: (r[0], r[1]))


def test_class_of_equal_bags(spark):
    """One class holds all documents of one bag and m; a crowd keeps its least ids only."""
    docs = spark.createDataFrame([(i, f"a b unknown{i}") for i in range(500)] + [(900, "a b b")], "doc_id long, text string")
    block = bag_search.Block([(1, "a b c")])
    found = bag_search.classes(bag_search.bags(docs, block), 501, 1503).collect()
    assert sorted(r.doc_ids for r in found) == [list(range(20)), [900]]


def test_no_ids_and_text_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (4, "zz")], "doc_id long, text string")
    items = spark.createDataFrame([("first", "A"), ("first", "A"), (None, "a")], "item_id string, text string")
    got = bag_search.search(docs, items).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.item_id == "first"] == [3, 3, None, None]
    assert len(got) == 8


def test_odd_rows(spark):
    docs = odd(spark, "score double, rank int, terms string, item_id long")
    items = odd(spark).withColumnRenamed("doc_id", "item_id").selectExpr("item_id", "text", "'x' AS doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = bag_search.search(docs, items).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, sorted({(i, t) for i, t in rows}, key=str)), key=key)
    assert bag_search.search(docs.limit(0), items).count() == 0 and bag_search.search(docs, items.limit(0)).count() == 0
    assert bag_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
