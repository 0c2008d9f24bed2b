"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their distinct 5-word shingles: partition c has the sizes over
2**(c-1) up to 2**c. For each partition a document is read in overlapping windows of 2 * 2**c shingles,
2**c apart, so that an item that lies in the document lies in one window, and an item that is
contained by at least ``CONTAINED`` in a window has a Jaccard similarity of at least 0.17 with it.
Window and item share one of ``HASHES`` minima with probability over 1 - 0.83**64 > 0.99999. A window's
minima of block pairs come from minima of blocks, and blocks of one partition from those of the
partition below, so that each shingle is hashed ``HASHES`` times in all.

A document gives away only minima that some item may have: a Bloom filter of bounded size (false
hits are settled by the join) goes with the tasks. Candidates are
confirmed by exact containment: the share of the item's shingles that are shingles of the document.

Shingles are compared by 64-bit hashes. Null texts, and items without words, take part in nothing;
rows without an id cannot be named and give nothing; rows that share an id count as one document or
item. An empty table on either side gives no rows. Other columns are not read. Very long texts are slices
of their own. A filter has 32 bits a key and 16 MB at most; past 4 million keys more false hits pass it to the
join, which settles them: results stay the same, the rows shuffled grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrowtext import mixed, task_memory, text_slices, texts_shingles
from vellum.llm.filters import KeyFilter, filter_of, without
from vellum.llm.store import stored

HASHES = 64
#: Share of an item's shingles, in hundredths, that a document with the item has at least.
CONTAINED = 75

_random = np.random.default_rng(2)
_FACTORS = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the groups of so many elements."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def partition_of(size: int) -> int:
    """The partition of an item of so many shingles."""
    return max(0, int(size - 1).bit_length())


def keys_of(minima: np.ndarray, partition: int) -> np.ndarray:
    """Keys of minima (a row for each hash) within a partition."""
    return mixed(minima + (np.arange(HASHES, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(partition * 0xD6E8FEB86659FD93 % (1 << 64))))


def minima_of(shingles: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Minima of each hash (a row) over the groups of shingles that begin at ``firsts``."""
    out = np.empty((HASHES, len(firsts)), np.uint64)
    for k in range(HASHES):
        hashed = shingles * _FACTORS[k]
        hashed ^= hashed >> np.uint64(32)
        out[k] = np.minimum.reduceat(hashed, firsts)
    return out


def window_keys(shingles: np.ndarray, firsts: np.ndarray, partitions: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each partition, texts of windows and the windows' keys (a row for each hash)."""
    counts = np.diff(firsts)
    text = np.flatnonzero(counts)
    if not len(text):
        return
    base = 1 << partitions[0]
    blocks = -(-counts[text] // base)
    minima = minima_of(shingles, np.repeat(firsts[text], blocks) + base * ragged(blocks))
    at = np.concatenate([[0], np.cumsum(blocks)])
    last = partitions[0]
    for partition in partitions:
        if partition > last:
            factor = 1 << (partition - last)
            groups = -(-blocks // factor)
            minima = np.minimum.reduceat(minima, np.repeat(at[:-1], groups) + factor * ragged(groups), axis=1)
            blocks, at, last = groups, np.concatenate([[0], np.cumsum(groups)]), partition
        owner = np.repeat(text, blocks)
        pair = np.flatnonzero((owner[1:] == owner[:-1])) if len(owner) > 1 else np.zeros(0, np.int64)
        alone = at[:-1][blocks == 1]
        both = np.concatenate([np.minimum(minima[:, pair], minima[:, pair + 1]), minima[:, alone]], axis=1)
        yield np.concatenate([owner[pair], owner[alone]]), keys_of(both, partition)


def item_keys(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, size, partition, shingles, keys) of the items that have words."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in source:
                rows, sizes, partitions, sets, keys = [], [], [], [], []
                for row, end, data, offsets in text_slices(batch.column(1)):
                    hashes, firsts = texts_shingles(data, offsets)
                    for i in range(end - row):
                        own = np.unique(hashes[firsts[i] : firsts[i + 1]])
                        if len(own):
                            rows.append(row + i)
                            sizes.append(len(own))
                            partitions.append(partition_of(len(own)))
                            sets.append(own.view(np.int64))
                            keys.append(keys_of(minima_of(own, np.zeros(1, np.int64)), partitions[-1])[:, 0].view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(partitions, pa.int32()),
                    pa.array(sets, pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ], ["id", "size", "partition", "shingles", "keys"])

    columns = items.select(items[id_column].alias("id"), items[text_column].cast("string").alias("text")).where("id is not null")
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, size long, partition int, shingles array<long>, keys array<long>")


def document_hits(docs: DataFrame, partitions: list[int], minima: KeyFilter, shingles: KeyFilter, id_column: str, text_column: str) -> DataFrame:
    """(id, minimum, key): keys of documents' windows, and their shingles, that some item may have."""
    shared = docs.sparkSession.sparkContext.broadcast((minima, shingles))  # of bounded size

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, shingles = shared.value
        with task_memory():
            for batch in source:
                for row, end, data, offsets in text_slices(batch.column(1)):
                    hashes, firsts = texts_shingles(data, offsets)
                    texts, kinds, keys = [], [], []

                    def add(text: np.ndarray, found: np.ndarray, minimum: bool) -> None:
                        own = np.unique(np.stack([text.astype(np.uint64), found]), axis=1)
                        texts.append(own[0].astype(np.int64))
                        keys.append(own[1])
                        kinds.append(np.full(own.shape[1], minimum))

                    for owner, found in window_keys(hashes, firsts, partitions):
                        k, i = np.nonzero(minima.has(found))
                        add(owner[i], found[k, i], True)
                    at = np.flatnonzero(shingles.has(hashes))
                    add(np.searchsorted(firsts, at, side="right") - 1, hashes[at], False)
                    text, key, kind = np.concatenate(texts), np.concatenate(keys), np.concatenate(kinds)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, end - row).take(pa.array(text)), pa.array(kind), pa.array(key.view(np.int64))], ["id", "minimum", "key"]
                    )

    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text")).where("id is not null")
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, minimum boolean, key long")


def contained_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, ``n_item``, ``n_shared``, ``containment``) of the items that documents contain."""
    found, members = _contained(docs, items, id_column, text_column, item_column, item_text)
    found = found.join(members, "item")
    return found.select(F.col("doc").alias(id_column), F.col("member").alias(item_column), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _contained(docs: DataFrame, items: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(doc, item, n_item, n_shared) for one item of each class of equal texts, and (item, member), the items of the classes, stored."""
    own = items.select(items[item_column].alias("member"), items[item_text].cast("string").alias("text")).where("member is not null and text is not null")
    first = own.groupBy("text").agg(F.min("member").alias("item"))
    members = stored(own.join(first, "text").select("item", "member").distinct(), "members")
    rows = stored(item_keys(first, "item", "text"), "items")
    partitions = sorted(r.partition for r in rows.select("partition").distinct().collect())
    minima = rows.select("id", F.explode("keys").alias("key")).distinct()
    shingles = rows.select("id", F.explode("shingles").alias("key")).distinct()
    sizes = shingles.groupBy("id").agg(F.count("*").alias("n_item"))
    if not partitions:
        none = docs.select(docs[id_column].alias("doc"), F.lit(None).cast(rows.schema["id"].dataType).alias("item")).where("false")
        return none.select("doc", "item", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")), members
    hits = stored(document_hits(docs, partitions, filter_of(minima, "key"), filter_of(shingles, "key"), id_column, text_column), "hits")
    candidates = hits.where("minimum").join(minima.withColumnRenamed("id", "item"), "key").select("id", "item").distinct()
    candidates = stored(candidates, "candidates")
    own = hits.where("not minimum").select("id", "key").distinct()
    # candidates meet their items' shingles first, so that a shingle of many items and documents multiplies nothing
    wanted = candidates.join(shingles.withColumnRenamed("id", "item"), "item")
    shared = wanted.join(own.hint("merge"), ["id", "key"]).groupBy("id", "item").agg(F.count("*").alias("n_shared"))
    found = shared.join(sizes.withColumnRenamed("id", "item"), "item").where(F.col("n_shared") * 100 >= F.col("n_item") * CONTAINED)
    return found.select(F.col("id").alias("doc"), "item", "n_item", "n_shared"), members


def without_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay."""
    found, _ = _contained(docs, items, id_column, text_column, item_column, item_text)
    return without(docs, stored(found.select(F.col("doc").alias(id_column)).distinct(), "leaks"), id_column)
