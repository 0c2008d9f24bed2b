"""Images of patents: references, their files, and candidates for matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import image_key

ROTATIONS = (0, 90, 180, 270)
ROLES = ("drawing", "inline")


def expanded(patents: DataFrame, key: str, references: str, files: str, abstract: str) -> DataFrame:
    """(key, file_name, image_role): references first, then files that none of them names, then the abstract's figure."""
    named = F.transform(F.coalesce(references, F.array()), lambda r: image_key(r["file_name"]))
    own = F.transform(F.coalesce(references, F.array()), lambda r: F.struct(r["file_name"].alias("file_name"), r["image_role"].alias("image_role")))
    other = F.filter(F.coalesce(files, F.array()), lambda f: ~F.array_contains(F.transform(named, lambda n: n), image_key(f)))
    more = F.transform(other, lambda f: F.struct(f.alias("file_name"), F.lit("drawing").alias("image_role")))
    last = F.when(F.col(abstract).isNotNull(), F.array(F.struct(F.col(abstract).alias("file_name"), F.lit("abstract").alias("image_role")))).otherwise(F.array().cast("array<struct<file_name:string,image_role:string>>"))
    return patents.select(key, F.posexplode(F.concat(own, more, last)).alias("sort_order", "image")).select(key, "sort_order", "image.*")


def with_entries(references: DataFrame, entries: DataFrame, file_name: str = "file_name", entry_name: str = "entry_name") -> DataFrame:
    """References with the archive entry of the same base name, whatever its case and folder, of several the first by name; null where there is none."""
    others = [c for c in entries.columns if c != entry_name]
    keyed = entries.groupBy(image_key(F.col(entry_name)).alias("image_key")).agg(F.min_by(F.struct(entry_name, *others), F.struct(entry_name, *others)).alias("entry"))
    return references.withColumn("image_key", image_key(F.col(file_name))).join(keyed.select("image_key", "entry.*"), "image_key", "left")


def same_content(images: DataFrame, key: str, digest: str) -> DataFrame:
    """Each of a patent's images with the first of equal content, its canonical one, as a match of score 1 that needs no turning; images without an equal match themselves."""
    first = images.groupBy(key, digest).agg(F.min("file_name").alias("matched_file_name"))
    found = images.join(first, [key, digest])
    return found.select(key, "file_name", "matched_file_name", F.lit(1.0).alias("match_score"), F.lit(0).alias("display_rotation"))


def candidates(images: DataFrame, key: str, is_abstract: Column) -> DataFrame:
    """(key, file_name, drawing, rotation): the abstract's figure of a patent against each of its drawings, in all rotations that are tried."""
    figures = images.where(is_abstract).select(key, "file_name")
    drawings = images.where(~is_abstract).select(key, F.col("file_name").alias("drawing"))
    return turned(figures.join(drawings, key))


def turned(images: DataFrame) -> DataFrame:
    """Images once for each rotation that is tried."""
    return images.withColumn("rotation", F.explode(F.array(*map(F.lit, ROTATIONS))))


def shown_order(is_abstract: Column, role: Column, file_name: Column) -> list[Column]:
    """The abstract's figure first, then drawings, images in the text, others; by name."""
    rank = F.when(role == "drawing", 0).when(role == "inline", 1).otherwise(2)
    return [is_abstract.desc(), rank.asc(), file_name.asc()]


def by_section(images: DataFrame, key: str, section: str = "source_section", default: str = "InventionMode") -> DataFrame:
    """Names of images in the text by section, in order."""
    names = F.array_join(F.array_sort(F.collect_set("file_name")), ",").alias("files")
    return images.groupBy(key, F.coalesce(section, F.lit(default)).alias(section)).agg(names)


def totals(images: DataFrame) -> DataFrame:
    """How many images there are, were stored, passed over, failed."""
    return images.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("uploaded", "skipped", "failed")])
