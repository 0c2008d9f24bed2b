"""Exact duplicates by two passes with a Bloom filter.

Texts are equal if they are the same after all of ``[\\x20\\x09-\\x0D]`` is deleted; their SHA-256 stands for them.

1. The first pass counts every digest at two places of a filter of bounded size (``filters.repeated_filter``) and keeps the
   places that were met twice: digests that may be repeated.
2. The second pass holds each row against them. Rows that no other can equal pass straight through; only the others, and of
   these the digest, length and id, are shuffled and grouped. What passes by chance is a group of one.

Of equal texts the row with the most code points in its original text stays, then the one of the smallest id (none
comes last), and of rows that also have the same id and length exactly one. A group of any size is combined in the tasks before the
shuffle, and the join back to its rows is split by Spark where it is skewed. Null texts count as empty, and
empty texts and those of white space alone are equal to each other. Very long texts are read whole. Columns beside id and text
are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.filters import member, repeated_filter
from vellum.llm.store import stored, unused

BLANKS = r"[\x20\x09-\x0D]"


def digest(text: Column) -> Column:
    """SHA-256 of a text without its white space, as binary; a null text is empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, ""), 256))


def _length(text: Column) -> Column:
    return F.coalesce(F.char_length(text.cast("string")), F.lit(0)).cast("long")


def duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``keep_id`` (the id of the row that stays), ``group_size``, ``kept`` and ``text_sha256`` (in hexadecimal)."""
    text = docs[text_column]
    rows = stored(docs.select(docs[id_column].alias("id"), _length(text).alias("length"), digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    key = F.xxhash64("digest")
    marked = rows.withColumn("may", member(rows, repeated_filter(rows.select(key.alias("key")), "key"), key))
    rest = marked.where("may")
    first = F.min(F.struct((-F.col("length")).alias("length"), F.col("id").isNull().alias("unnamed"), "id", "row"))
    groups = stored(rest.groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("first")), "groups")
    # neither side has a bound
    grouped = rest.join(groups.hint("merge"), "digest").select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
    alone = marked.where("not may").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.union(grouped).select(F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Rows that may have an equal are combined in their tasks first, so that a group sends one row from each task.
    """
    text = docs[text_column]
    keys = stored(docs.select(F.xxhash64(digest(text)).alias("key")), "keys")
    own, may, row = (unused(docs.columns, c) for c in ("digest", "may", "row"))
    keyed = docs.withColumn(own, digest(text))
    marked = keyed.withColumn(may, member(keyed, repeated_filter(keys, "key"), F.xxhash64(own)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct((-_length(F.col(f"`{text_column}`"))).alias("length"), F.col(f"`{id_column}`").isNull().alias("unnamed"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    first = marked.where(F.col(may)).groupBy(own).agg(F.min_by(F.struct(*columns), order).alias(row))
    return marked.where(~F.col(may)).select(*columns).unionByName(first.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
