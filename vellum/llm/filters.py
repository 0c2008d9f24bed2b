"""Bloom filters of bounded size, made by SQL and used in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.store import unused

#: Bits of a filter for each key that it holds, and at most (16 MB); beyond, more false keys pass.
BITS_PER_KEY, FILTER_BITS = 32, 1 << 27


class KeyFilter:
    """A Bloom filter of two bits a key, as 64-bit words."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)
        a, b = keys & mask, (keys >> np.uint64(32)) & mask
        bit = lambda x: (self.words[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
        return (bit(a) & bit(b)).astype(bool)


def filter_of(keys: DataFrame, column: str) -> KeyFilter:
    """A filter of a column of longs, made of bits that are set by SQL; its words are what reaches the driver."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (n * BITS_PER_KEY - 1).bit_length()))
    place = F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(bits - 1)))
    words = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set"))
    found = words.toArrow()
    out = KeyFilter(bits)
    out.words[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
    return out


def member(rows: DataFrame, held: KeyFilter, key: Column) -> Column:
    """Whether a key of ``rows`` may be in the filter; only the keys go to Python."""
    shared = rows.sparkSession.sparkContext.broadcast(held)  # of bounded size

    def has(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(keys.to_numpy(np.int64).view(np.uint64)))

    return F.pandas_udf(has, T.BooleanType())(key)


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``rows`` whose value of ``column`` is not among those of ``gone`` (one column, stored). All columns stay.

    Only rows that may be among them are shuffled for the join, whatever the number of rows.
    """
    name = gone.columns[0]
    held = filter_of(gone.where(F.col(name).isNotNull()).select(F.xxhash64(name).alias("key")).distinct(), "key")
    may, lost = unused(rows.columns, "may"), unused(rows.columns, "gone")
    marked = rows.withColumn(may, member(rows, held, F.xxhash64(rows[column])))
    kept = marked.where(F.col(may)).drop(may).join(gone.select(F.col(name).alias(lost)).hint("merge"), F.col(column) == F.col(lost), "left_anti")
    return marked.where(~F.col(may)).drop(may).unionByName(kept)


#: Counters of a block of a filter of repeated keys, and keys that a task holds before it passes their counters on.
COUNTERS, HELD_KEYS = 1 << 16, 1 << 20


def repeated_filter(keys: DataFrame, column: str) -> KeyFilter:
    """A filter of the values of a column of longs that may occur more than once; every one that does is in it.

    Each key counts at both of its places, and a place's bit is set where the count reaches two. A task sends the places that it has
    counted, block by block, two bytes each; blocks are added up where they meet, whatever the order. What reaches the driver are
    the bits, ``FILTER_BITS`` at most: beyond that size more keys that occur once pass as well. Nulls are no keys.
    """
    keys = keys.select(column).where(F.col(column).isNotNull())
    n = keys.count()
    bits = min(FILTER_BITS, max(COUNTERS, 1 << (max(n, 1) * BITS_PER_KEY - 1).bit_length()))

    def counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
        own = np.concatenate(waiting)
        mask = np.uint64(bits - 1)
        places, times = np.unique(np.concatenate([own & mask, (own >> np.uint64(32)) & mask]), return_counts=True)
        block = (places // np.uint64(COUNTERS)).astype(np.int64)
        low, twice = (places % np.uint64(COUNTERS)).astype("<u2"), times > 1
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parts = list(zip(heads, np.append(heads[1:], len(block))))
        sides = [pa.array([low[a:b][twice[a:b] == side].tobytes() for a, b in parts], pa.binary()) for side in (False, True)]
        return pa.RecordBatch.from_arrays([pa.array(block[heads]), *sides], ["block", "once", "twice"])

    def tasks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in source:
            if batch.num_rows:
                waiting.append(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
                held += batch.num_rows
            if held >= HELD_KEYS:
                yield counted(waiting)
                waiting, held = [], 0
        if waiting:
            yield counted(waiting)

    def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, np.zeros(COUNTERS, np.uint8)

        def out() -> pa.RecordBatch:
            words = np.packbits(counts >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([words], pa.binary())], ["block", "bits"])

        for batch in source:
            for own, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own != block:
                    if block is not None:
                        yield out()
                    block, counts = own, np.zeros(COUNTERS, np.uint8)
                for places, times in ((once, 1), (twice, 2)):
                    at = np.frombuffer(places, "<u2")
                    counts[at] = np.minimum(counts[at] + times, 2)
        if block is not None:
            yield out()

    sent = keys.mapInArrow(tasks, "block long, once binary, twice binary")
    blocks = sent.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block long, bits binary").toArrow()
    found = KeyFilter(bits)
    for block, words in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist()):
        found.words[block * (COUNTERS // 64) : (block + 1) * (COUNTERS // 64)] = np.frombuffer(words, "<u8")
    return found
