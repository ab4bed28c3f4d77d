"""The pipeline against the operators' plain functions, and the entry point without the optional part."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
from helpers import SF, components, odd
from tidemark.llm import decontaminate, pieces, quality_crf, secret_scan
from tidemark.llm.common import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text or "" for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality_crf.held_out())
    model = quality_crf.fit(docs, labels)
    good = {i for i, s in zip(texts, quality_crf.score_texts(list(texts.values()), model)) if s >= quality_crf.KEEP}
    after = [good]
    first = components({i: texts[i] for i in good})
    after.append({i for i in good if first[i] == i})
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    search = decontaminate.Items([r.item_id for r in items], [r.text for r in items])
    after.append({i for i in after[-1] if not search.find([texts[i]])[0]})
    after.append(after[-1])
    assert len(texts) > len(after[0]) > len(after[1]) > len(after[2]) > 0
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], after):
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == want
    clean = {r.doc_id: r for r in docs.collect()}
    assert any("[SECRET]" in r.text for r in clean.values()) and all(r.n_chars == len(r.text) for r in clean.values())
    assert secret_scan.scan(docs).where("size(assign) + size(access) + size(hex) > 0").count() == 0
    coded = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    raw = pieces.Vocabulary(pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model")), 1.0).raw
    assert {r.doc_id for r in coded} == clean.keys() and all(pieces.decode_ids(r.ids, raw) == clean[r.doc_id].text for r in coded)


def test_near_copies_by_row(spark):
    """Texts are judged each by itself, whether they share an id or have none."""
    base = " ".join(f"word{i}" for i in range(60))
    near, other, third = base.replace("word30", "changed"), base.replace("word", "term"), base.replace("word", "name")
    rows = [(7, base, "a"), (3, near, "b"),            # near copies: the lesser id stays
            (5, other, "c"), (5, third, "d"),          # one id, two texts: both stay
            (5, other, "c"),                           # a repeated row
            (None, base, "e"), (None, near, "f"),      # near copies without an id give way to one with an id
            (None, "alone " * 30, "g"), (None, third + " more", "h"),
            (9, None, "i"), (9, "", "j"), (None, None, "k"), (None, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = sorted((r.extra for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()))
    assert got == list("bcdgijk")
    lone = spark.createDataFrame([(None, base, "a"), (None, near, "b"), (None, other, "c")], docs.schema)
    got = corpus_pipeline.drop_near_copies(spark, lone, SF)
    assert got.columns == docs.columns
    kept = [r.extra for r in got.collect()]
    assert len(kept) == 2 and "c" in kept


def test_odd_tables(spark, tmp_path):
    folder = str(tmp_path / "odd")
    odd(spark, "lang string, n_chars long, score double, leaks string").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, None}
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_entry_without_the_corpus_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    left = tmp_path / "repo"
    shutil.copytree(root, left, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                          cwd=left, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[0] == said.stdout.split()[1], said.stderr
