"""Batches: states from a log of changes, failures in log details, time left, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "downloading", "downloaded", "processing", "processed", "importing", "completed", "failed")
ACTIVE = ("downloading", "processing", "importing")
ENDED = ("completed", "failed")

#: Failures that a log entry may carry: of patents in an import, or of files in a check.
DETAILS = "failures array<struct<patent_number:string,kind:string,title:string,source_file:string,error:string,file:string,expected:string,actual:string,reason:string>>"


def current(changes: DataFrame, key: str, status: str, time: str, ties: str) -> DataFrame:
    """The state of each batch: its last status, when it first left ``pending``, and when it ended, if it has."""
    last = F.max_by(F.struct(status, time), F.struct(time, ties)).alias("last")
    rows = changes.groupBy(key).agg(last, F.min(F.when(F.col(status) != "pending", F.col(time))).alias("started_at"))
    return rows.select(key, F.col(f"last.{status}").alias(status), "started_at", F.when(F.col(f"last.{status}").isin(*ENDED), F.col(f"last.{time}")).alias("completed_at"))


def listed(batches: DataFrame, status: str | None = None, active: bool = False) -> DataFrame:
    """Batches that are being worked on, or in a state; ``active`` goes before ``status``."""
    if active:
        return batches.where(F.col("status").isin(*ACTIVE))
    return batches.where(F.col("status") == status) if status else batches


def failures(logs: DataFrame, details: str = "details") -> DataFrame:
    """Failures that log entries carry as JSON, a row each: of imports (with ``error``) and of files (with ``reason``)."""
    rows = logs.withColumn("failure", F.explode(F.from_json(details, DETAILS)["failures"]))
    rows = rows.withColumn("kind_of_failure", F.when(F.col("failure.patent_number").isNotNull(), "import").when(F.col("failure.file").isNotNull(), "file"))
    return rows.where("kind_of_failure is not null")


def seconds_left(total: Column, done: Column, speed: Column) -> Column:
    """Time that the rest takes at a speed; null where nothing moves."""
    return F.when(speed > 0, F.ceil(F.greatest(total - done, F.lit(0)) / speed))


def unfinished(archives: DataFrame, checkpoints: DataFrame, keys: tuple[str, ...] = ("version", "name", "size", "modified")) -> DataFrame:
    """Archives without a checkpoint of the same version, name, size and time."""
    return archives.join(checkpoints.select(*keys).distinct(), list(keys), "left_anti")


def reconciled(batches: DataFrame, found: DataFrame) -> DataFrame:
    """(batch, previous, status) of batches (batch, status) by what is on disk and in the database; completed ones stay as they are.

    ``found`` has for each batch with a folder: ``parsed`` (patents in the parsed file, null without one), ``imported``, ``extracted``
    (whether there is an unpacked folder), ``files``, and ``whole`` (whether the downloaded archive passed its check).
    """
    f = F.col
    rows = batches.join(found, "batch", "left")
    state = (
        F.when(f("status") == "completed", "completed")
        .when(f("files").isNull(), "pending")
        .when(f("parsed").isNotNull(), F.when((f("parsed") > 0) & (f("imported") >= f("parsed")), "completed").otherwise("processed"))
        .when(f("extracted"), "downloaded")
        .when((f("files") > 0) & f("whole"), "downloaded")
        .otherwise("pending")
    )
    return rows.select("batch", f("status").alias("previous"), state.alias("status"))


def latest_of(batches: DataFrame, column: str, value: str, time: str = "created_at") -> DataFrame:
    """The newest batch with a value in a column."""
    return batches.where(F.col(column) == value).orderBy(F.col(time).desc_nulls_last(), "batch_code").limit(1)


def size_of(files: DataFrame, key: str) -> DataFrame:
    """Files of each batch and their bytes."""
    return files.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def newest_logs(logs: DataFrame, batch: str, most: int = 100) -> DataFrame:
    """The newest entries of a batch's log, the last first."""
    return logs.where(F.col("batch_code") == batch).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(most)
