import random
import re

import __spark_entry__ as contract
from helpers import SF, odd, texts_of
from tidemark.llm import license_scan as scan


def containment(text, notice):
    words, want = re.findall("[a-z0-9]+", text.lower()), scan._shingles(scan._words(notice))
    size, best = scan.size_of(len(scan._words(notice))), 0.0
    for at in range(max(1, len(words))):
        have = set(scan._shingles(words[at:at + size]))
        best = max(best, len(have & set(want)) / len(want))
    return best


def test_query(spark):
    got = {(r.doc_id, r.license) for r in contract.queries()["op8_license_scan"](spark, SF).collect()}
    want = {(i, name) for i, t in texts_of(spark).items() for name, notice in scan.TEMPLATES if "icense" in t and containment(t, notice) >= scan.LEAST}
    assert got == want and want


def test_planted_notices(spark):
    rand = random.Random(2)
    filler = lambda n: " ".join("".join(rand.choice("abcde") for _ in range(5)) for _ in range(n))
    rows, truth = [], set()
    for i in range(120):
        name, notice = scan.TEMPLATES[i % len(scan.TEMPLATES)]
        words = notice.split()
        if i % 3 == 1 and len(words) > 20:
            words[-1] = "changed"
        rows.append((i, f"{filler(rand.randrange(60))} {' '.join(words).upper() if i % 2 else ' '.join(words)} {filler(rand.randrange(60))}"))
        truth.add((i, name))
    rows += [(1000 + i, filler(50) + " a licence permits software and copyright " + filler(50)) for i in range(20)]
    got = {(r.doc_id, r.license) for r in scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == truth


def test_anchors_are_lossless():
    scan._check(scan.TEMPLATES)
    try:
        scan._check([("x", "nothing here says what this is about at all")])
    except ValueError:
        return
    raise AssertionError


def test_odd_rows(spark):
    docs = odd(spark, "license int, size string, band string")
    assert scan.scan(docs).count() == 0 and scan.scan(docs.limit(0)).count() == 0


def test_bands_hold_their_bound(spark):
    """The least similar window of every template is missed with a chance of one in ten thousand at most."""
    for _, notice in scan.TEMPLATES:
        words = scan._words(notice)
        n, size = len(scan._shingles(words)), scan.size_of(len(words))
        held = -(-3 * n // 4)
        like = held / (max(size - 4, held) + n - held)
        assert (1 - like) ** scan._bands(scan.TEMPLATES)[size] <= 1e-4
    for short in ["MIT License", "the software license here"]:
        try:
            scan.templates_of(spark, [("x", short)])
        except ValueError:
            continue
        raise AssertionError


def test_short_notice_in_many_texts(spark):
    rand = random.Random(9)
    filler = lambda: " ".join("".join(rand.choice("abcde") for _ in range(6)) for _ in range(rand.randrange(20, 40)))
    rows = [(i, f"{filler()} Released under the MIT License. {filler()}") for i in range(2000)]
    assert scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2000
