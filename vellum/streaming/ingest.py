"""New archives as a stream: each micro-batch is parsed, checked and merged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Merge = Callable[[DataFrame, int], None]


def new_files(spark: SparkSession, folder: str, pattern: str = "*.json", schema: str = "doc_number string, kind string, title string, ts timestamp_ntz") -> DataFrame:
    """Records of files that arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 100).json(folder)


def distinct_arrivals(records: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Records without repeats of a key within ``delay``; older state is dropped."""
    return records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def arrivals_by_window(records: DataFrame, time: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Records by window of arrival, late ones within ``delay`` counted."""
    rows = records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return rows.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), "rows")


def merged(records: DataFrame, merge: Merge, checkpoint: str) -> StreamingQuery:
    """Runs ``merge(batch, number)`` on what has arrived, then ends; a batch that was merged is not merged again."""
    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
