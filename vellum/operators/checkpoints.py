"""Archives processed once each, whatever ends a run: records first, then a checkpoint for each archive.

A run writes the records of the archives that have no checkpoint of their version, name, size, time and options, under its own number, and
then the checkpoints, which name the run. Records count only if the newest checkpoint of their archive names their run, so a run that was
killed in between leaves nothing behind that is read, and an archive that has changed is replaced as a whole, even by no records.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.batches import unfinished

#: What a checkpoint is known by.
KEYS = ("version", "name", "size", "modified", "options")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def process(archives: DataFrame, parse: Callable[[DataFrame], DataFrame], root: str, version: int = 1, options: str = "") -> DataFrame | None:
    """The records of all (name, size, modified) ``archives``; only those without a checkpoint are parsed.

    ``parse`` gets rows of ``archives`` and gives records with the archive's ``name``. None if no run has ever had a record.
    """
    spark, run = archives.sparkSession, uuid.uuid4().hex
    listed = archives.select("name", "size", "modified").withColumns({"version": F.lit(version), "options": F.lit(options)})
    done = _read(spark, f"{root}/checkpoints")
    todo = listed if done is None else unfinished(listed, done, KEYS)
    todo.write.parquet(f"{root}/runs/{run}")  # both writes go by one list
    todo = spark.read.parquet(f"{root}/runs/{run}")
    if not todo.isEmpty():
        parse(todo.select("name", "size", "modified")).write.parquet(f"{root}/records/run={run}")
        made = spark.read.parquet(f"{root}/records/run={run}").groupBy("name").agg(F.count("*").alias("records"))
        rows = todo.join(made, "name", "left").na.fill(0, ["records"])
        rows.withColumns({"run": F.lit(run), "done_at": F.current_timestamp()}).write.mode("append").parquet(f"{root}/checkpoints")
    return records(archives, root, version, options)


def checkpoints(archives: DataFrame, root: str, version: int = 1, options: str = "") -> DataFrame | None:
    """The newest checkpoint of each archive as it is now; None before the first run."""
    done = _read(archives.sparkSession, f"{root}/checkpoints")
    if done is None:
        return None
    now = archives.select("name", "size", "modified").distinct()
    own = done.where((F.col("version") == version) & (F.col("options") == options)).join(now, ["name", "size", "modified"])
    whole = F.struct(*[c for c in own.columns if c != "name"])
    return own.groupBy("name").agg(F.max_by(whole, F.struct("done_at", "run")).alias("last")).select("name", "last.*")


def records(archives: DataFrame, root: str, version: int = 1, options: str = "") -> DataFrame | None:
    """The records of the archives that are done, each once."""
    found, done = _read(archives.sparkSession, f"{root}/records"), checkpoints(archives, root, version, options)
    if found is None or done is None:
        return None
    return found.join(done.select("name", "run"), ["name", "run"], "left_semi").drop("run")
