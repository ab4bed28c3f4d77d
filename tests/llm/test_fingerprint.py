import hashlib

import __spark_entry__ as contract
from helpers import SF, odd, texts_of
from pyspark.sql import functions as F
from tidemark.llm import fingerprint as imatch
from tidemark.llm.neighbours import with_next


def test_query(spark):
    rows = {r.doc_id: r for r in contract.queries()["op1_imatch_fingerprints"](spark, SF).collect()}
    texts = texts_of(spark)
    assert rows.keys() == texts.keys()
    ids = sorted(texts, reverse=True)
    for i, other in zip(ids, ids[1:] + ids[:1]):
        a, half = texts[i], len(texts[i]) // 2
        edited = a[:len(a) - half] + texts[other][:half]
        assert rows[i].n_chars == len(a)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (texts[i] == edited) <= (rows[i].near_edited == 1)
        assert 0 <= rows[i].near_next <= 1
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
    above = sum(a.near_edited > b.near_next for a in rows.values() for b in rows.values()) / len(rows) ** 2
    assert above > 0.95


def test_lexicon_counts_all_documents(spark):
    texts = texts_of(spark)
    low, high = 0.03, 0.2
    df = {}
    for t in texts.values():
        for w in set(t.lower().split()):
            df[w] = df.get(w, 0) + 1
    want = sorted(w for w, n in df.items() if low * len(texts) <= n <= high * len(texts))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert imatch.lexicon(docs, low, high) == want
    few = imatch.lexicon(docs, low, high, most=20)
    assert 0 < len(few) <= 20 and set(few) <= set(want)


def test_signature_is_of_the_band_only(spark):
    held = dict(zip(["blue", "green"], imatch._membership(["blue", "green"])))
    assert imatch.fingerprint_of("green the blue x".split(), held) == imatch.fingerprint_of("blue blue green y".split(), held)
    assert imatch.fingerprint_of([], held) == bytes(8 + 2 * len(imatch.RATES))
    assert imatch.fingerprint_of(["x"], held) != imatch.fingerprint_of(["y"], held)


def test_odd_rows(spark):
    docs = odd(spark)
    got = imatch.fingerprints(docs, imatch.lexicon(docs), out="score")
    assert got.columns == docs.columns and got.count() == docs.count()
    assert imatch.lexicon(docs.limit(0)) == []


def test_neighbours_with_ties_and_nulls(spark):
    def nexts(rows):
        df = spark.createDataFrame(rows, "k long, v string").repartition(5)
        return sorted(((r.k, r.v, r.after) for r in with_next(df, "k", {"v": "after"}, F.col("v")).collect()), key=str)

    assert nexts([(1, "a"), (5, "b"), (3, "c")]) == [(1, "a", "b"), (3, "c", "a"), (5, "b", "c")]
    assert nexts([(7, "a")]) == [(7, "a", "a")]
    assert nexts([(2, "a"), (2, "b"), (1, "c")]) == [(1, "c", "a"), (2, "a", "b"), (2, "b", "c")]
    assert nexts([(None, "n"), (4, "a")]) == [(4, "a", "n"), (None, "n", "a")]
    assert nexts([(None, "m"), (None, "n")]) == [(None, "m", "n"), (None, "n", "m")]
    many = [(i, str(i)) for i in range(500)]
    assert nexts(many) == sorted(((i, str(i), str((i - 1) % 500)) for i in range(500)), key=str)
    assert with_next(spark.createDataFrame([], "k long, v string"), "k", {"v": "after"}, F.col("v")).count() == 0


def test_one_python_step_per_stage(spark):
    plan = contract.queries()["op1_imatch_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 2, plan


def test_likeness_in_the_step_is_that_of_the_column(spark):
    got = contract.queries()["op1_imatch_fingerprints"](spark, SF)
    again = got.withColumn("_near", imatch.likeness(F.unhex("fingerprint"), F.unhex("edited_fingerprint")))
    assert again.where("_near <> near_edited").count() == 0 and got.where("near_edited > 0").count() > 0
