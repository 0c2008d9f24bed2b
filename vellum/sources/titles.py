"""Title lists of classifications: lines of code, level and title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions.text import trimmed
from vellum.sources import archives


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the text files at a path, whatever the case of their ending, and of those in archives there."""
    texts = spark.read.text(path, recursiveFileLookup=True, wholetext=True, pathGlobFilter="*.[tT][xX][tT]").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    packed = archives.entries(spark, path, (".txt",)).where("error is null").select(F.col("entry_name").alias("file"), F.decode("content", "UTF-8").alias("text"))
    return numbered(texts.unionByName(packed))


def numbered(texts: DataFrame) -> DataFrame:
    """(file, line_no, line) of the lines of (file, text) texts, from 1."""
    rows = texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return rows.select("file", (F.col("at") + 1).alias("line_no"), "line")


def _parsed(rows: DataFrame, code, level, title) -> DataFrame:
    rows = rows.select("file", "line_no", "line", trimmed(code).alias("source_code"), level.cast("int").alias("stated_level"), trimmed(title).alias("title_en"))
    rows = rows.where("source_code <> '' and title_en <> ''").withColumn("code_norm", codes.normalized(F.col("source_code")))
    error = F.when(F.col("code_norm").isNull(), F.concat("file", F.lit(":"), "line_no", F.lit(": invalid code")))
    return rows.withColumn("error", error).withColumn("level", F.coalesce("stated_level", codes.depth(F.col("code_norm"))))


def checked(rows: DataFrame) -> DataFrame:
    """Parsed lines; one with an ``error`` fails the job, as an import does."""
    return rows.withColumn("code_norm", F.when(F.col("error").isNull(), F.col("code_norm")).otherwise(F.raise_error(F.col("error")).cast("string")))


def two_columns(rows: DataFrame) -> DataFrame:
    """Lines of code and title; blank ones and those without a title are passed over, invalid codes get ``error``, with file and line."""
    parts = F.split("line", "\t", 2)
    return _parsed(rows, parts[0], F.lit(None), F.get(parts, F.lit(1)))


def three_columns(rows: DataFrame) -> DataFrame:
    """Lines of code, level (a number or nothing) and title."""
    parts = F.split("line", "\t", 3)
    level = F.get(parts, F.lit(1))
    return _parsed(rows, parts[0], F.when(level.rlike(r"^[0-9]+\z"), level), F.get(parts, F.lit(2)))
