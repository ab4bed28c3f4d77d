import random
from collections import defaultdict

import pytest
from helpers import AZ, odd
from tidemark.llm import line_runs

BLANK = " \t\n\x0b\x0c\r"


def brute(texts, least):
    """Per row: number of lines, dropped lines, what is left."""
    holders = defaultdict(set)
    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            holders[line.strip(BLANK).translate(AZ)].add(i)
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(BLANK) or len(holders[x.strip(BLANK).translate(AZ)]) < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def made(seed, rows=80):
    rand = random.Random(seed)
    pool = ["Menu", " menu\t", "MENU", "É line", "é line", "", " \x0b ", "漢字 x", "All rights reserved.", "a" * 40, " ", "x\x00y"]
    pool += [f"line {i}" for i in range(40)]
    texts = ["\n".join(rand.choice(pool) for _ in range(rand.randrange(0, 12))) for _ in range(rows)]
    return texts + [texts[0]] * 7 + ["Menu\n" * 3000, None, ""]


@pytest.mark.parametrize("least, fanout, parts", [(10, 4, 1), (3, 2, 11), (5, 3, 7), (1, 2, 3)])
def test_brute_force(spark, least, fanout, parts):
    """However the rows are dealt over batches, levels and merges."""
    texts = made(least)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    batches = [docs.where(f"doc_id % {parts} = {i}") for i in range(parts)]
    got = {r.doc_id: r for r in line_runs.remove_frequent(docs, batches, least, fanout).collect()}
    for i, (n, gone, left) in enumerate(brute(texts, least)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text or "") == (n, gone, left)
    assert got[len(texts) - 2].text is None


def test_levels(spark):
    """Runs move up, settled keys are not counted again, and a batch of a known name adds nothing."""
    runs = line_runs.LineRuns(spark, least=3, fanout=2, buckets=4)
    for i in range(9):
        docs = spark.createDataFrame([(f"common\nonce {i}\ncommon",)], "text string")
        runs.add(docs, name=i)
        runs.add(docs, name=i)
    assert [n for _, n in runs.counts] == [1, 0, 0, 1]
    assert sum(r.docs for r in runs.rows(runs.counts).collect()) == 9 and runs.rows(runs.settled).count() >= 1
    assert runs.frequent().count() == 1


def test_runs_are_not_shuffled(spark):
    runs = line_runs.LineRuns(spark, least=2, fanout=2, buckets=4)
    for i in range(3):
        runs.add(spark.createDataFrame([("a\nb",), (f"a\nc{i}",)], "text string"))
    plan = runs.frequent()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_runs.remove_frequent(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    docs = odd(spark, "score double, n_lines string, h1 int, _row int, place int, text2 string")
    got = line_runs.remove_frequent(docs, least=2)
    assert sorted(got.columns) == sorted([*docs.columns, "n_dropped"])
    rows = got.collect()
    assert len(rows) == docs.count()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows if (r.doc_id or 9) < 4) == [(1, ""), (1, ""), (2, ""), (3, "")]
    assert {r.n_lines for r in rows if r.doc_id == 4} == {2}
    empty = line_runs.remove_frequent(docs.limit(0))
    assert empty.count() == 0
    assert line_runs.LineRuns(spark).frequent().count() == 0
    with pytest.raises(ValueError):
        line_runs.LineRuns(spark, least=0)


def test_long_text(spark):
    """A line in ten documents, in one of them 50,000 times among as many other lines."""
    long = "\n".join(x for i in range(50_000) for x in ("again", f"own {i}"))
    docs = spark.createDataFrame([(i, "again") for i in range(9)] + [(9, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_runs.remove_frequent(docs).collect()}
    assert got[9].n_dropped == 50_000 and got[9].text == "\n".join(f"own {i}" for i in range(50_000)) and got[0].text == ""
