"""From raw documents to token samples in stages; each stage's rows are written and read again.

1. quality: documents that the line field scores below ``quality_crf.KEEP`` go.
2. near copies: of each component of linked rows the one of least doc_id stays. A row is its id and its text: several texts of
   one id, and texts without an id, are each judged by their own text; where rows of a component tie by id, one hash of id
   and text decides. Rows equal in both become one.
3. decontamination: documents that hold a benchmark item go.
4. secrets: found spans give way to a mark; no document goes. ``n_chars`` is renewed.
5. tokens: two sampled segmentations of every document that is left.

Extra columns pass through the first four stages. Empty tables pass through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, pieces, quality_crf, secret_scan
from tidemark.llm.common import read, stored

#: The vocabulary of the last stage.
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(~quality_crf.held_out()).select("doc_id", "quality")
    model = quality_crf.fit(docs, labels)
    return quality_crf.score(docs, model, "_score").where(F.col("_score") >= quality_crf.KEEP).drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    found = ngram_join.join(keyed.select(F.col("_row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row_key"), "component_id").distinct()
    # Ids are known by row; of a component the row of least id stays, rows without an id coming last.
    named = keyed.select("_row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key").alias("_rank")).join(found, "_row_key")
    kept = named.groupBy("component_id").agg(F.min("_rank")["_row_key"].alias("_row_key")).select("_row_key")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    again = Window.partitionBy("_row_key", "doc_id", "text").orderBy(F.xxhash64(*plain))
    numbered = keyed.join(kept, "_row_key", "left_semi").withColumn("_row_no", F.row_number().over(again))
    return numbered.where("_row_no = 1").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"), "_leaks")
    return found.where(F.size("_leaks") == 0).drop("_leaks")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.model_bytes(VOCABULARY), keep=("doc_id",))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", sample_pieces),
]

#: No SQL: the field, the fingerprints and the samples are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
