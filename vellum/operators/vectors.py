"""Similarity search over vectors and bit strings, exact."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many finite numbers."""
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(rows: DataFrame, vector: str, query: list[float], k: int = 10, ties: str = "vec_id") -> DataFrame:
    """The ``k`` rows most alike a query vector, with ``similarity``; each task keeps ``k`` rows."""
    asked, length = F.array(*[F.lit(float(x)) for x in query]), math.sqrt(sum(float(x) * float(x) for x in query))
    alike = F.try_divide(dot(F.col(vector), asked), F.sqrt(dot(F.col(vector), F.col(vector))) * length)
    found = rows.withColumn("similarity", alike).where("similarity is not null")
    return found.orderBy(F.desc("similarity"), ties).limit(k)


def sign_bits(vector: Column) -> Column:
    """The signs of up to 64 numbers as a long."""
    bit = lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("long"), bit)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def image_score(hash_score: Column, pixel_score: Column, structure_score: Column) -> Column:
    """Likeness of two images from that of their hashes, pixels and structure."""
    return 0.2 * hash_score + 0.5 * pixel_score + 0.3 * structure_score


def best_matches(pairs: DataFrame, group: str, prefilter: str, score: str, keep: int = 5, least: float = 0.75, ties: str = "candidate") -> DataFrame:
    """For each group the pair of best ``score`` among the ``keep`` of best ``prefilter``, if it reaches ``least``."""
    order = W.partitionBy(group).orderBy(F.desc(prefilter), ties)
    few = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    top = few.groupBy(group).agg(F.max_by(F.struct(*[c for c in pairs.columns if c != group]), F.struct(F.col(score), -F.col("rank"))).alias("best"))
    return top.select(group, "best.*").where(F.col(score) >= least)


def embedded(rows: DataFrame, text: str, embed, dimensions: int, column: str = "embedding") -> DataFrame:
    """``rows`` with the vector that ``embed`` (a list of texts to a list of vectors) gives for a text; called once a batch of rows.

    A vector of another length, or with a number that is not finite, fails the job.
    """
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed(texts.tolist())])

    made = rows.withColumn(column, of(F.col(text)))
    checked = F.when(valid(F.col(column), dimensions), F.col(column)).otherwise(F.raise_error(F.lit(f"an embedding has not {dimensions} finite numbers")).cast("array<double>"))
    return made.withColumn(column, checked)


def semantic_search(embeddings: DataFrame, dictionary: DataFrame, query: list[float], k: int = 10, most: int = 100, section: str | None = None, **equal: str) -> DataFrame:
    """The dictionary's entries most alike a query vector, with ``similarity`` and ``percent``.

    ``equal`` names columns of ``embeddings`` and the value that each must have (type, locale, model, version).
    Only vectors of the query's length count. Each task keeps ``k`` rows.
    """
    rows = embeddings.where(valid(F.col("embedding"), len(query)))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    entries = dictionary.where(F.col("section") == section) if section else dictionary
    rows = rows.join(entries, ["code_norm", "version"])
    found = nearest(rows, "embedding", query, min(max(1, k), most), "code_norm")
    return found.withColumn("percent", F.format_string("%.1f%%", F.col("similarity") * 100))


def search_by_text(embeddings: DataFrame, dictionary: DataFrame, text: str, embed, k: int = 10, **options) -> DataFrame:
    """The dictionary's entries most alike a text, whose vector ``embed`` (a list of texts to a list of vectors) gives."""
    if not text.strip():
        raise ValueError("a search text is empty")
    return semantic_search(embeddings, dictionary, [float(x) for x in embed([text.strip()])[0]], k, **options)
