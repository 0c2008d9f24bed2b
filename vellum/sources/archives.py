"""Entries of ZIP and gzip archives as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import archive_ranges
from vellum.sources.archive_ranges import SCHEMA, Parts, chunks_of, handed_on, read_members
from vellum.sources.stores import opens


def entries(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".xml",)) -> DataFrame:
    """(zip_name, entry_name, content, error): a row for each wanted entry of the archives in a folder, and of archives in these, under their own name.

    An archive or entry that cannot be read gives a row with ``error``; directories are passed over. A gzip file is an
    archive of one entry, named as the file without its ending. Where tasks can open the store's files themselves, archives of any size are read
    by ranges, split ones too; in a store that only Spark reads, an archive is one file of under 2 GB and the work of one task.
    """
    return archive_ranges.entries(spark, folder, suffixes) if opens(folder) else whole_entries(spark, folder, suffixes)


def whole_entries(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".xml",)) -> DataFrame:
    """The same of archives that Spark reads, each whole."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[zZ][iI][pP],[gG][zZ]}").option("recursiveFileLookup", True).load(folder)

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from handed_on(_entries_of(Parts.held(path, content.as_buffer()), suffixes))

    return found.select("path", "content").mapInArrow(rows, SCHEMA)


def _entries_of(parts: Parts, suffixes: tuple[str, ...]) -> Iterator[tuple]:
    for name, _, _, members, error in chunks_of(parts, suffixes):
        if error is not None:
            yield name, None, None, error
        yield from read_members(name, parts, members, suffixes)


def counts(rows: DataFrame) -> DataFrame:
    """Entries read and failed of each archive."""
    return rows.groupBy("zip_name").agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("skipped"))
