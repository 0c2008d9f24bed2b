"""The corpus pipeline: stages that turn raw documents into encoded, deduplicated training text.

Documents have ``doc_id``, ``text`` and ``lang``; all other columns stay as they are, but for ``n_chars``, the length of
the text, which follows it where it is there. In every stage a null text counts as empty, rows that repeat are each
looked at, ties go to the smallest ``doc_id``, very long texts are read whole, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from vellum.llm.store import removed as deleted
from vellum.llm.store import small_batches, stored, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learned from the labelled ones; the rejected go.

    Texts without a letter are rejected. Without any labelled row nothing else is, as nothing is known that a text could be unlike.
    """
    small_batches(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later repeats of runs of lines; documents of which nothing is left go.

    Near copies lose the lines that they share with the first of them here, so few are left for the next stage. Texts
    that were blank before stay; rows without an id are not cut.
    """
    removed = unused(docs.columns, "removed")
    cut = line_dedup.dedup_lines(docs, removed_column=removed)
    cut = cut.where((F.col(removed) == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n_chars)
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Texts without words are no copies of each other."""
    return near_dedup.without_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; all of them if there is no item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is kept: number and digest of the ids, digest of the decoded text. An empty text has no ids."""
    small_batches(spark)
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("byte-level BPE", encode),
]

#: SQL cannot express a learned model, minima of hashes or BPE merges: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; what the next has been made of is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            deleted(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
