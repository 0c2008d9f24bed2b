"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, decontaminate, divergence, exact_dedup, hard_negatives, language_id, license_scan, line_dedup, lm_score, near_dedup, personal_data, simhash, token_counts
from vellum.llm.store import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out."""
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain, with the share of their shingles."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the later repeats of runs of lines, and the number of lines deleted."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), removed_column="n_removed")
    return found.select("doc_id", "text", "n_removed")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every text by a network that is trained on all of them."""
    return lm_score.score_all(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text, with what their template saves and how their wording differs."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the rules' finds, and the learned tagger's added to them."""
    return personal_data.find_all(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text: number and digest of the ids, digest of the bytes decoded from them."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text as the tokenizers library counts them, and whether they are over 512."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text and its edited text, and how alike they and the next document are."""
    return simhash.edited(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents and the document that each keeps."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors and their positives; labels of ids divisible by 7 are moved on by one first."""
    rows, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(rows.withColumn("label", moved))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that each has more of than its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row that each keeps."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_license_scan": op5_license_scan,
    "op6_personal_data": op6_personal_data,
    "op7_bpe": op7_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprints": op9_fingerprints,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_dedup": op13_exact_dedup,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.n, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.n <> b.n
  WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT n, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, other_id) AS k
  FROM s WHERE same
  QUALIFY k <= 5
),
h AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.n, p.k ORDER BY s.score DESC, s.other_id) AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON p.n = s.n AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 10
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
t AS (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM t GROUP BY ALL HAVING count(DISTINCT n) >= 10),
langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(lang_count), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY ALL
),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL
),
prices AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (g.n + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_count + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM prices WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_exact_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST, n)
""",
}
