"""The corpus operators applied to their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as imatch
from tidemark.llm import (
    bag_search, decontaminate, html_cut, license_scan, line_runs, ngram_join, pieces, quality_crf, secret_scan, sentence_spans, token_links,
    url_rules)
from tidemark.llm.common import read, whole
from tidemark.llm.neighbours import with_next

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def declare(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return declare


@query("op1_imatch_fingerprints")
def op1_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text: the second half replaced by the next document's start."""
    docs = read(spark, folder, "documents").select("doc_id", whole().alias("text"))
    terms = imatch.lexicon(docs)
    own = imatch.fingerprints(docs.withColumn("n_chars", F.length("text").cast("long")), terms, packed_as="text")
    pairs = with_next(own, "doc_id", {"text": "next_text", "fingerprint": "next_fingerprint"}, F.xxhash64("text"))
    return imatch.edited(pairs, terms, "text", "next_text", "fingerprint", "next_fingerprint").select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next")


@query("op2_main_text")
def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = html_cut.extract(read(spark, folder, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.scan(read(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = secret_scan.KINDS[:3]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(secret_scan.KINDS).alias("spans"))


@query("op6_url_filter", r"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END AS u FROM pages),
parts AS (SELECT page_id, html, u, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query FROM cut),
named AS (SELECT *, host || path || query AS address FROM parts),
rules(action, name, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (SELECT address, host, path, unnest(list_concat(
    [regexp_extract(t, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1) FOR t IN regexp_extract_all(seen,
      '(?i)<link\s(?:[^>]*\s)?rel\s*=\s*["'']?canonical(?:["''\s][^>]*)?>')],
    [regexp_extract(t, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) FOR t IN regexp_extract_all(seen,
      '(?i)<meta\s(?:[^>]*\s)?http-equiv\s*=\s*["'']?refresh(?:["''\s][^>]*)?>')])) AS link
  FROM (SELECT *, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', ' ', 'g') AS seen FROM named WHERE host <> '')),
targets AS (SELECT address AS a, CASE WHEN link LIKE '%://%' THEN substr(link, strpos(link, '://') + 3)
    WHEN link LIKE '//%' THEN substr(link, 3) WHEN link LIKE '/%' THEN host || link
    ELSE host || CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^.*/') ELSE '/' END || link END AS u
  FROM (SELECT address, host, path, replace(link, '&amp;', '&') AS link FROM tags WHERE link <> '')),
pairs AS (SELECT a, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(u, '^[^/?#]*([^?#]*)', 1) || regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS b FROM targets),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (SELECT a AS v, a AS w FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON r.w = e.a),
ruled AS (SELECT w, host, path, (SELECT arg_max(action, length(name) + length(start)) FROM rules WHERE (host = name OR
    suffix(host, '.' || name)) AND starts_with(path, start)) AS action
  FROM (SELECT DISTINCT w, regexp_extract(w, '^[^/?#]*') AS host, regexp_extract(w, '^[^/?#]*([^?#]*)', 1) AS path FROM reach)),
alias AS (SELECT v, max(action = 'block') AND NOT coalesce(max(action = 'allow'), FALSE) AS blocked
  FROM reach JOIN ruled USING (w) GROUP BY v),
own AS (SELECT page_id, host, path, address, (SELECT arg_max({'r': name || start, 'a': action}, length(name) + length(start))
    FROM rules WHERE (host = name OR suffix(host, '.' || name)) AND starts_with(path, start)) AS hit FROM named)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, hit.r AS rule,
  coalesce(hit.a, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict FROM own LEFT JOIN alias ON address = v
""")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's address."""
    judged = url_rules.judge(read(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_quality_crf")
def op10_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; one in five labels is held out."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").where(~quality_crf.held_out()).select("doc_id", "quality")
    scored = quality_crf.score(docs, quality_crf.fit(docs, labels))
    return scored.select("doc_id", quality_crf.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality_crf.KEEP).cast("int").alias("predicted"))


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's shingle set, and the component its links make."""
    return ngram_join.join(read(spark, folder, "documents").select("doc_id", "text"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, its first word and the similarity."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, folder, "benchmark"))
    # for a plain explode Spark filters empty arrays first, and finds the leaks twice for it
    return found.select("doc_id", F.explode_outer("leaks").alias("leak")).where("leak IS NOT NULL").select(
        "doc_id", "leak.item_id", F.col("leak.start").alias("first_word"), "leak.similarity")


@query("op7_sampled_pieces")
def op7_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, digested, and whether decoding gives the text back."""
    model = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    docs = read(spark, folder, "documents").select("doc_id", whole().alias("text"))
    known = docs.withColumn("text_sha256", F.sha2("text", 256))
    return pieces.encode_digests(known, model, keep=("doc_id", "text_sha256")).select(
        "doc_id", "sample", "n_pieces", "ids_sha256", "log_prob", "log_inclusion",
        (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip"))


@query("op5_repeated_spans")
def op5_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the sentences of repeated spans that occur earlier."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs).select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document that holds one."""
    return license_scan.scan(read(spark, folder, "documents").select("doc_id", "text"))


@query("op11_line_dedup", r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often ON k.key = often.key GROUP BY doc_id
""")
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold; the table's files are added in eight batches."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = line_runs.remove_frequent(docs, line_runs.batches_of(docs, 8))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(whole(), 256).alias("kept_sha256"))


@query("op12_bag_search", r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM sizes, totals),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM tf JOIN q USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""")
def op12_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return bag_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op13_token_links")
def op13_token_links(spark: SparkSession, folder: str) -> DataFrame:
    """How the tokens of two public tokenizers lie over each other in every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    a, b = (pieces.model_bytes(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_links.digests(docs, a, b).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
