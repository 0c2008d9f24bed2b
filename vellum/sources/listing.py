"""Directory listings and plans of downloads, as tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import is_download
from vellum.shared import new_folder
from vellum.sources.stores import store_of

#: Directories that a task lists, on average, and tasks of a level at most; entries that are handed on together.
LISTED, TASKS, HANDED = 16, 4096, 10_000
ENTRY = "path string, name string, type string, size long, modified timestamp"


def walk(spark: SparkSession, folder: str, levels: int | None = None) -> DataFrame:
    """(path, name, type, size, modified) of all below a folder: files, empty ones too, and directories, whose size is 0.

    Directories are listed by tasks, a level of the tree at a time, so the time goes with the depth and not with the number of
    entries; ``levels`` ends it sooner. A directory that is gone when its turn comes has no entries; if the folder itself is
    not there, ``FileNotFoundError`` is raised.
    """
    store, inner = store_of(folder)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        raise FileNotFoundError(folder)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path in batch.column(0).to_pylist():
                store, inner = store_of(path)
                found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
                for at in range(0, len(found), HANDED):
                    some = [(f"{path.rstrip('/')}/{x.base_name}", x.base_name, "directory" if x.type == fs.FileType.Directory else "file", x.size or 0, x.mtime) for x in found[at : at + HANDED]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["path", "name", "type", "size", "modified"])

    level, found, directories = spark.createDataFrame([(folder,)], "path string"), [], 1
    root = new_folder(spark, "listing")
    while directories and (levels is None or len(found) < levels):
        tasks = min(TASKS, -(-directories // LISTED))
        level.select("path").repartition(tasks, "path").mapInArrow(listed, ENTRY).write.parquet(f"{root}/{len(found)}")
        found.append(spark.read.schema(ENTRY).parquet(f"{root}/{len(found)}"))
        level = found[-1].where("type = 'directory'")
        directories = level.count()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], ENTRY)


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, size, modified) of the files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def browse_order(entries: DataFrame) -> DataFrame:
    """Directories first, then by name."""
    return entries.orderBy((F.col("type") == "directory").desc(), "name")


def folders_like(entries: DataFrame, pattern: str) -> DataFrame:
    """Directories whose name a pattern is found in."""
    return entries.where((F.col("type") == "directory") & F.col("name").rlike(pattern))


def data_folders(entries: DataFrame, base: str) -> DataFrame:
    """Directories two levels below ``base`` (a year, then a week), the last name first."""
    parent = lambda c: F.regexp_replace(c, "/[^/]*/?\\z", "")
    folders = entries.where(F.col("type") == "directory")
    years = folders.where(parent(F.col("path")) == base.rstrip("/")).select(F.col("path").alias("year"))
    return folders.join(years, parent(F.col("path")) == F.col("year"), "left_semi").orderBy(F.collate("name", "UNICODE").desc(), "path")


def download_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What is to be fetched of (name, size) files: state, and bytes that are there already."""
    have = local.select("name", F.col("size").alias("have"))
    rows = remote.where(is_download(F.col("name"))).join(have, "name", "left")
    state = F.when(F.col("have") == F.col("size"), "skipped").when(F.col("have") > 0, "partial").otherwise("pending")
    return rows.select("name", "size", state.alias("state"), F.least(F.greatest(F.coalesce("have", F.lit(0)), F.lit(0)), "size").alias("done"))


def archive_groups(names: DataFrame) -> DataFrame:
    """(base, kind, parts) of archives in (name) files: split ones have a ``.zip`` and ``.z01``.. parts, in order with the main file last."""
    lower = F.lower("name")
    rows = names.where(lower.rlike(r"\.(zip|z\d{1,2}|gz)\z") & ~lower.endswith(".merged.zip"))
    number = F.regexp_extract(lower, r"\.z(\d{1,2})\z", 1)
    part = F.when(number != "", number.cast("int")).otherwise(1000)
    rows = rows.select(F.regexp_replace("name", r"(?i)\.(zip|z\d{1,2}|gz)\z", "").alias("base"), lower.endswith(".gz").alias("gz"), part.alias("part"), "name")
    groups = rows.groupBy("base", "gz").agg(F.array_sort(F.collect_list(F.struct("part", "name"))).alias("all"))
    has_main = F.exists("all", lambda x: x["part"] == 1000)
    kind = F.when(F.col("gz"), "gzip").when((F.size("all") > 1) & has_main, "split").otherwise("zip")
    return groups.where(has_main).select("base", kind.alias("kind"), F.transform("all", lambda x: x["name"]).alias("parts"))
