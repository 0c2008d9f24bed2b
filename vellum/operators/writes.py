"""Writes of the pipeline's tables: each gives the next version of the tables it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import log_message, non_empty
from vellum.operators.merge import first_of_each, upserted, without_parents
from vellum.schemas import CHILDREN

#: Columns of an asset, a dictionary entry and an embedding that a newer row replaces; ``perceptual_hash`` only if there is a new one.
ASSET = ["content_hash", "perceptual_hash", "content_type", "size", "width", "height"]
ENTRY = ["code", "source_code", "version", "section", "class_code", "subclass", "main_group", "subgroup", "level", "title_en", "title_zh", "title_zh_source", "source_file", "updated_at"]
EMBEDDING_KEY = ["type", "code_norm", "version", "locale", "embedding_model"]
EMBEDDING = ["embedding_dimensions", "content_hash", "content", "embedding", "embedded_at"]


def without_batch(tables: dict[str, DataFrame], batch: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a batch, its patents, their children and its log; and one row, ``deleted``, the number of patents.

    ``tables`` may hold patent, sync_batches, sync_logs and any of patent's child tables; image assets stay.
    """
    patents = tables["patent"]
    gone = patents.where(F.col("batch_id") == batch).select(F.col("id").alias("patent_id"))
    out = {name: without_parents(table, gone, "patent_id") if name in CHILDREN else table for name, table in tables.items()}
    out["patent"] = patents.where(~F.col("batch_id").eqNullSafe(F.lit(batch)))
    for name in ("sync_batches", "sync_logs"):
        if name in tables:
            out[name] = tables[name].where(~F.col("batch_code").eqNullSafe(F.lit(batch)))
    return out, gone.agg(F.count("*").alias("deleted"))


def content_hash(given: Column, oss_key: Column, digest: bool = False) -> Column:
    """The hash of an image's content; where none was kept, one that its key stands in for, as it is or digested."""
    return F.coalesce(non_empty(given), F.concat(F.lit("legacy:"), F.md5(oss_key) if digest else oss_key))


def upserted_assets(old: DataFrame, images: DataFrame, position: Column) -> DataFrame:
    """Assets with those of new images merged in by key; of images that share a key the first counts."""
    new = first_of_each(images.withColumn("content_hash", content_hash(F.col("content_hash"), F.col("oss_key"))), ["oss_key"], position)
    new = new.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("width", "height")})
    return upserted(old, new, ["oss_key"], ASSET, ["perceptual_hash"])


def image_rows(images: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows of patent_image with the id of their asset; images without an asset are left out, rows that repeat are one."""
    ids = assets.select("oss_key", F.col("id").alias("asset_id"))
    role = F.coalesce(non_empty(F.col("image_role")), F.when(F.col("is_abstract"), "abstract").otherwise("drawing"))
    return images.join(ids, "oss_key").withColumns({"image_role": role, "display_rotation": F.coalesce("display_rotation", F.lit(0))}).dropDuplicates()


def upserted_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """A dictionary with new entries merged in by code; all columns are taken over."""
    return upserted(old, new, ["code_norm"], [c for c in ENTRY if c in old.columns])


def upserted_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings with new ones merged in by type, code, version, locale and model."""
    return upserted(old, new, EMBEDDING_KEY, [c for c in EMBEDDING if c in old.columns])


def log_rows(entries: DataFrame) -> DataFrame:
    """Log entries as they are kept: messages in today's wording."""
    return entries.withColumn("message", log_message(F.col("message")))


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to the log at a path; what is there stays."""
    log_rows(entries).write.mode("append").parquet(path)
