import random

from helpers import odd
from tidemark.llm import sentence_spans as spans
from tidemark.llm.sentence_spans import remove_repeats, runs_of, sentences_of


def brute(rows):
    """Removed sentence numbers of every document: runs compared as word tuples."""
    cut = {}
    for i, text in rows.items():
        starts = sentences_of(text)[0]
        cut[i] = [tuple(text[a:b].lower().split()) for a, b in zip(starts, starts[1:])]
    first, found = {}, []
    for i in sorted(cut):
        n = len(cut[i])
        runs = set()
        for a in range(n):
            ends = [b for b in range(a + spans.SENTENCES, n + 1) if sum(map(len, cut[i][a:b])) >= spans.WORDS]
            if ends:
                runs.add((a, ends[0]))
        for b in range(1, n + 1):
            begins = [a for a in range(b - spans.SENTENCES, -1, -1) if sum(map(len, cut[i][a:b])) >= spans.WORDS]
            if begins:
                runs.add((begins[0], b))
        for a, b in sorted(runs):
            key = tuple(cut[i][a:b])
            first[key] = min(first.get(key, (i, a)), (i, a))
            found.append((i, a, b, key))
    gone = {i: set() for i in rows}
    for i, a, b, key in found:
        if first[key] != (i, a):
            gone[i].update(range(a, b))
    return gone, cut


def test_brute_force(spark):
    rand = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    pool = [" ".join(rand.choice(words) for _ in range(rand.randrange(1, 14))).capitalize() + rand.choice(".!?") for _ in range(25)]
    rows = {}
    for i in range(60):
        parts = [p for _ in range(rand.randrange(0, 5)) for p in pool[rand.randrange(20):][:rand.randrange(1, 7)]]
        rows[i] = "".join(p + rand.choice([" ", "\n", "  "]) for p in parts).rstrip()
    want, cut = brute(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert sum(map(len, want.values())) > 50
    for i in rows:
        left = [w for k, s in enumerate(cut[i]) if k not in want[i] for w in s]
        assert got[i].n_removed == len(want[i]) and got[i].text.lower().split() == left
        assert want[i] or got[i].text == rows[i]


def test_planted_passage(spark):
    rand = random.Random(5)
    word = lambda: "".join(rand.choice("abcdefgh") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(rand.randrange(4, 16))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(7))
    own = {i: [" ".join(sentence() for _ in range(5)) for _ in range(2)] for i in range(30)}
    rows = [(i, f"{a}\n{passage}\n{b}") for i, (a, b) in own.items()]
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"{own[i][0]}\n{own[i][1]}" for i in range(1, 30))


def test_runs_do_not_depend_on_place():
    text = "One two three four five six. Seven eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen! Nineteen twenty? End it."
    here, there = runs_of(text)[0], runs_of("Hello there. " + text + " More.\nAnd 3.5 more")[0]
    assert len(here) and set(here.tolist()) <= set(there.tolist())


def test_odd_rows(spark):
    docs = odd(spark, "n_chars double, n_removed string, spans int")
    got = remove_repeats(docs)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == docs.count()
    assert remove_repeats(docs.limit(0)).count() == 0


def test_long_sentences(spark):
    """Passages of 51 words cut out of sentences of any length, and copies of one long sentence."""
    rand = random.Random(6)
    word = lambda: "".join(rand.choice("abcdefgh") for _ in range(6))
    rows, truth = [], {}
    for i in range(120):
        step = [0, 13, 20, 60][i % 4]
        passage = [word() + ("." if step and rand.randrange(step) == 0 else "") for _ in range(51)]
        rows.append((i, " ".join([word() for _ in range(rand.randrange(30))] + passage + [word() for _ in range(rand.randrange(30))])))
        own = [word() for _ in range(rand.randrange(1, 30))], [word() for _ in range(rand.randrange(1, 30))]
        rows.append((1000 + i, " ".join([*own[0], *passage, *own[1]])))
        truth[1000 + i] = passage, own
    whole = " ".join(word() for _ in range(101))
    rows += [(3000, whole), (3001, whole)]
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3000] == whole and got[3001] == ""
    assert all(got[i] == text for i, text in rows if i < 1000)
    for i, (passage, own) in truth.items():
        left = got[i].split()
        assert len(set(left) & set(passage)) <= 51 - spans.WORDS and set(own[0] + own[1]) <= set(left), i


def test_rows_without_an_id(spark):
    """Each is a document of its own; so are other texts of one id."""
    rand = random.Random(8)
    text = lambda: " ".join("".join(rand.choice("abcdefgh") for _ in range(6)) + "." * (j % 8 == 7) for j in range(64))
    copied, other, third, twin = text(), text(), text(), text()
    rows = [(1, copied), (None, copied), (None, other), (None, third), (None, third), (2, copied), (2, twin), (3, third[:0])]
    got = [(r.doc_id, r.text) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(1, copied), (None, ""), (None, other), (None, third), (None, ""), (2, ""), (2, twin), (3, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_are_made_once(spark):
    text = " ".join(f"Word{i} of a sentence that is here." for i in range(12))
    keyed = spans._keyed(spark.createDataFrame([(1, text), (2, "First of all. " + text + " And last.")], "doc_id long, text string"))
    found = spans.repeated_spans(keyed)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    (row,) = found.collect()
    starts = sentences_of("First of all. " + text + " And last.")[0].tolist()
    assert row.doc_id == 2 and all((s.start, s.stop) == (starts[s.piece], starts[s.after]) for s in row.spans)
    assert {r.doc_id: r.n_removed for r in remove_repeats(keyed.select("doc_id", "text")).collect()} == {1: 0, 2: 12}
