"""Checks of batches: parts of split archives, and checksums against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import crc_text


def manifest_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, expected): the last comma parts path and checksum; the path's last part counts, eight upper-case digits."""
    parts = lines.select(F.regexp_extract(line, r"^(.*),\s*([0-9A-Fa-f]+)\s*\z", 1).alias("path"), F.regexp_extract(line, r"^(.*),\s*([0-9A-Fa-f]+)\s*\z", 2).alias("crc"))
    parts = parts.where("path <> ''")
    return parts.select(F.element_at(F.split("path", r"[\\/]"), -1).alias("name"), F.lpad(F.upper("crc"), 8, "0").alias("expected"))


def with_checksums(files: DataFrame) -> DataFrame:
    """(name, actual) of (path, content) files."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), crc_text(F.col("content")).alias("actual"))


#: What a report says of each reason.
REASONS = {
    "missing": "文件不存在", "uncovered": "ZIP 文件未出现在 CRC 清单中", "mismatch": "CRC32 不匹配", "no entries": "CRC 文件无有效校验条目", "damaged": "ZIP 结构损坏",
    "empty folder": "解压目录为空，文件可能未解压", "no archive": "解压目录中无 ZIP 文件，解压可能不完整",
}


def manifest_failures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, expected, actual, reason) of files that are missing, archives that the manifest does not cover, and files that differ; names are compared in lower case.

    ``actual`` has (name, actual) and may have ``opens``: whether the file opens as an archive; one that does not is damaged.
    """
    opens = "opens" in actual.columns
    e, a = expected.withColumn("key", F.lower("name")).alias("e"), actual.withColumn("key", F.lower("name")).alias("a")
    reason = F.when(F.col("a.key").isNull(), "missing").when(F.col("e.key").isNull(), F.when(F.col("a.key").endswith(".zip"), "uncovered")).when(F.col("expected") != F.col("actual"), "mismatch")
    if opens:
        reason = reason.when(~F.col("opens"), "damaged")
    joined = e.join(a, F.col("e.key") == F.col("a.key"), "full_outer")
    return joined.select(F.coalesce("e.name", "a.name").alias("file"), "expected", "actual", reason.alias("reason")).where("reason is not null")


def empty_manifests(lines: DataFrame, manifest: str = "manifest", line: str = "value") -> DataFrame:
    """(file, reason) of manifests (a column with their name, one with a line) without any line that names a file and a checksum."""
    valid = F.col(line).rlike(r"^(.+),\s*([0-9A-Fa-f]+)\s*\z")
    return lines.groupBy(F.col(manifest).alias("file")).agg(F.count_if(valid).alias("valid")).where("valid = 0").select("file", F.lit("no entries").alias("reason"))


def without_manifest(files: DataFrame, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, file, reason) for (folder, name, opens) ``files`` of ``folders`` that have no manifest: the folder is empty, has no archive, or an archive does not open."""
    archive = F.lower("name").endswith(".zip")
    counts = files.groupBy(folder).agg(F.count("*").alias("files"), F.count_if(archive).alias("archives"))
    empty = F.when(F.coalesce("files", F.lit(0)) == 0, "empty folder").when(F.col("archives") == 0, "no archive")
    whole = folders.select(folder).distinct().join(counts, folder, "left").select(folder, F.col(folder).alias("file"), empty.alias("reason")).where("reason is not null")
    damaged = files.where(archive & ~F.col("opens")).select(folder, F.col("name").alias("file"), F.lit("damaged").alias("reason"))
    return whole.unionByName(damaged)


def split_failures(parts: DataFrame) -> DataFrame:
    """(base, reason) of archives in (base, part, size) parts, part 0 the main file: it is missing, or parts are not 1..n, empty or of unequal size."""
    own = F.col("part") > 0
    groups = parts.groupBy("base").agg(
        F.count_if(~own).alias("mains"),
        F.count_if(own).alias("n"),
        F.countDistinct(F.when(own, F.col("part"))).alias("different"),
        F.max(F.when(own, F.col("part"))).alias("last"),
        F.min("size").alias("least"),
        F.min(F.when(own, F.col("size"))).alias("low"),
        F.max(F.when(own, F.col("size"))).alias("high"),
    )
    reason = (
        F.when(F.col("mains") == 0, "no main file")
        .when((F.col("n") > 0) & ((F.col("last") != F.col("n")) | (F.col("different") != F.col("n"))), "parts not in sequence")
        .when(F.col("least") == 0, "empty part")
        .when(F.col("low") != F.col("high"), "parts of unequal size")
    )
    return groups.select("base", reason.alias("reason")).where("reason is not null")


def report(failures: DataFrame) -> DataFrame:
    """A line of text for each failure."""
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("reason")), F.col("reason"))
    both = F.when(F.col("expected").isNotNull() & F.col("actual").isNotNull(), F.concat(F.lit(" (期望: "), "expected", F.lit(", 实际: "), "actual", F.lit(")"))).otherwise("")
    return failures.select(F.concat(F.lit("  - "), "file", F.lit(": "), said, both).alias("line"))
