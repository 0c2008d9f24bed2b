"""An index of the character trigrams of texts: a search for a value inside texts reads the rows that may have it.

Rows lie in blocks by a hash of their key; a block is a partition of a Parquet table, and a row has a number within it. For each trigram of a
column, in lower case as ``ILIKE`` compares, postings name blocks and rows, in partitions by a hash of the trigram; three code
points fit in a long, so trigrams are compared exactly.

What a LIKE pattern asks for between its wildcards gives trigrams that a row must have. The rarest few are intersected, the blocks that
are left are read, and the condition itself decides on their rows. So the result is that of a scan. A pattern
without three characters in a row, or whose rarest trigram is in more than a ``SCANNED`` share of rows, is answered by a scan.

Null texts have no trigrams. Rows that repeat are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, on average, and blocks at most; partitions of postings at most, and rows for each; files of a partition.
BLOCK_ROWS, BLOCKS, PARTS, PART_ROWS, FILES = 2048, 8192, 1024, 1 << 16, 4
#: Code points of texts that trigrams are made of at once.
SLICE = 1 << 20
#: Trigrams that are intersected; share of rows beyond which a scan is no dearer.
RAREST, SCANNED = 3, 0.25

_POSTINGS = "gram long, block int, places array<int>"


@dataclass
class Index:
    """An index that is stored: its folder, columns, number of rows and of partitions of postings, and the rows' schema."""

    spark: SparkSession
    path: str
    columns: list[str]
    rows: int
    parts: int
    schema: str

    def table(self) -> DataFrame:
        """The rows, with their block and place."""
        return self.spark.read.schema(f"{self.schema}, place int, block int").parquet(f"{self.path}/rows")


def trigrams(text: str) -> set[int]:
    """The trigrams of a text, three code points of 21 bits each."""
    c = [ord(x) for x in text]
    return {a | b << 21 | d << 42 for a, b, d in zip(c, c[1:], c[2:])}


def fragments(pattern: str) -> list[str]:
    r"""What a LIKE pattern, with ``\`` before characters that stand for themselves, has between its wildcards."""
    out, at = [""], 0
    while at < len(pattern):
        if pattern[at] in "%_":
            out.append("")
        else:
            at += pattern[at] == "\\"
            out[-1] += pattern[at : at + 1]
        at += 1
    return [x for x in out if x]


def part_of(gram: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts, each once a text, and the places of the texts; texts are read ``SLICE`` code points at a time."""
    whole, length = "".join(texts), np.array([len(x) for x in texts])
    owner_ends, found = np.cumsum(length), []
    for at in range(0, max(1, len(whole) - 2), SLICE):
        code = np.frombuffer(whole[at : at + SLICE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        gram = code[:-2] | code[1:-1] << 21 | code[2:] << 42
        first, last = (np.searchsorted(owner_ends, at + i + np.arange(len(gram)), "right") for i in (0, 2))
        gram, row = gram[first == last], first[first == last]
        found.append(_once(gram, row))
    gram, row = (np.concatenate(x) for x in zip(*found))
    return (gram, row) if len(found) == 1 else _once(gram, row)


def _once(gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((row, gram))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], row[new]


def _postings(rows: DataFrame, column: str) -> DataFrame:
    """(gram, block, places): the rows of a block that have a trigram, some ``SLICE`` code points at a time."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            text, block, place = batch.column(2), *(batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            ends = np.cumsum(pc.utf8_length(text).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                gram, row = _grams(text.slice(at, to - at).to_pylist())
                block_of, place_of = block[at:to][row], place[at:to][row]
                at = to
                if not len(gram):
                    continue
                order = np.lexsort((place_of, block_of, gram))
                gram, block_of, place_of = gram[order], block_of[order], place_of[order]
                head = np.ones(len(gram), bool)
                head[1:] = (gram[1:] != gram[:-1]) | (block_of[1:] != block_of[:-1])
                first = np.flatnonzero(head)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)).astype(np.int32)), pa.array(place_of.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(block_of[first].astype(np.int32)), lists], ["gram", "block", "places"])

    texts = rows.select("block", "place", F.lower(F.col(f"`{column}`").cast("string")).alias("text")).where("text is not null")
    return texts.mapInArrow(batches, _POSTINGS)


def build(rows: DataFrame, path: str, columns: list[str], key: str) -> Index:
    """Stores ``rows``, none of whose columns may be named block or place, and an index of some of their columns at a path."""
    spark, n = rows.sparkSession, rows.count()
    blocks, parts = max(1, min(BLOCKS, n // BLOCK_ROWS)), max(1, min(PARTS, n // PART_ROWS))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    at = len(rows.columns)

    def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = None, 0
        for batch in source:
            own = batch.column(at).to_numpy()
            place = np.empty(len(own), np.int32)
            for a, b in zip(*(np.flatnonzero(x) for x in (np.append(True, own[1:] != own[:-1]), np.append(own[1:] != own[:-1], True)))) if len(own) else ():
                block, last = own[a], last if own[a] == block else 0
                place[a : b + 1] = np.arange(last, last + b + 1 - a)
                last += b + 1 - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartition(blocks, "block").sortWithinPartitions("block")
    dealt.mapInArrow(numbered, f"{kinds}, block int, place int").write.partitionBy("block").mode("overwrite").parquet(f"{path}/rows")
    index = Index(spark, path, columns, n, parts, kinds)
    for k, column in enumerate(columns):
        found = _postings(index.table(), column).withColumn("part", part_of("gram", parts))
        # a frequent trigram is in several files of its partition
        spread = found.repartition("part", F.pmod("block", F.lit(FILES))).sortWithinPartitions("part", "gram")
        spread.write.partitionBy("part").mode("overwrite").parquet(f"{path}/postings/{k}")
        counts = spark.read.schema(f"{_POSTINGS}, part int").parquet(f"{path}/postings/{k}").groupBy("part", "gram").agg(F.sum(F.size("places")).alias("rows"))
        counts.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").mode("overwrite").parquet(f"{path}/counts/{k}")
    return index


def _of_grams(index: Index, table: str, column: str, grams: list[int], schema: str) -> DataFrame:
    """Rows of a table of the index that are of some trigrams; only their partitions are read."""
    spark = index.spark
    parts = [r.part for r in spark.createDataFrame([(g,) for g in grams], "gram long").select(part_of("gram", index.parts).alias("part")).distinct().collect()]
    found = spark.read.schema(f"{schema}, part int").parquet(f"{index.path}/{table}/{index.columns.index(column)}")
    return found.where(F.col("part").isin(parts) & F.col("gram").isin(grams))


def candidates(index: Index, needs: list[tuple[str, str]]) -> DataFrame | None:
    """(block, place) of the rows that may fit all of some (column, LIKE pattern); None if that is no less than a scan."""
    asked: dict[str, set[int]] = {}
    lower = index.spark.createDataFrame(needs, "column string, pattern string").select("column", F.lower("pattern").alias("pattern")).collect()
    for row in lower:
        asked.setdefault(row["column"], set()).update(g for x in fragments(row.pattern) for g in trigrams(x))
    counts = []
    for column, grams in asked.items():
        if grams:
            there = {r.gram: r["rows"] for r in _of_grams(index, "counts", column, sorted(grams), "gram long, rows long").collect()}  # a row for each trigram asked for
            counts += [(there.get(g, 0), column, g) for g in grams]
    chosen = sorted(counts)[:RAREST]
    if not chosen or chosen[0][0] > SCANNED * index.rows:
        return None
    found = []
    for column in sorted({c for _, c, _ in chosen}):
        own = _of_grams(index, "postings", column, [g for _, c, g in chosen if c == column], _POSTINGS)
        found.append(own.select("block", F.explode("places").alias("place"), F.lit(column).alias("column"), "gram"))
    return reduce(DataFrame.union, found).groupBy("block", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("block", "place")


def find(index: Index, condition: Column, needs: list[list[tuple[str, str]]]) -> DataFrame:
    """The rows that meet a condition, which must imply one of the ``needs``: (column, LIKE pattern) that all fit."""
    rows = index.table()
    found = [candidates(index, some) for some in needs]
    if not found or any(f is None for f in found):
        return rows.where(condition).drop("block", "place")
    may = reduce(DataFrame.union, found).distinct()
    blocks = [r.block for r in may.select("block").distinct().collect()]  # ``BLOCKS`` at most
    return rows.where(F.col("block").isin(blocks)).join(may, ["block", "place"], "left_semi").where(condition).drop("block", "place")
