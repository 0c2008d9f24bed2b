"""Merges, deletes and removal of duplicates over versioned tables: each gives the table's next version."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str], if_present: list[str] = ()) -> DataFrame:
    """``old`` with ``new`` merged in, and ``is_new``.

    A known row takes the ``updated`` columns of the new one, those in ``if_present`` only if they are not
    null there; all its other columns stay. Keys are compared with null equal to null.
    """
    o, n = old.alias("o").withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    known, came = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        taken = F.coalesce(b, a) if c in if_present else b
        out.append(F.when(known & (F.lit(c in updated) & came), taken).when(known, a).otherwise(b).alias(c))
    return o.join(n, on, "full_outer").select(*out, (~known).alias("is_new"))


def replaced_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children where parents in ``new`` have theirs from there alone."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_parents(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is not among the ``deleted`` ones."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have not been done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def last_of_each(rows: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """The last row of each key, and ``first_position``, where the key came first."""
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    kept = rows.groupBy(*keys).agg(F.max_by(whole, position).alias("row"), F.min(position).alias("first_position"))
    return kept.select(*keys, "row.*", "first_position")


def first_of_each(rows: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """The first row of each key."""
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(whole, position).alias("row")).select(*keys, "row.*")


def filled_from(rows: DataFrame, other: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` in which null values are taken from the row of the same key in ``other``, where keys are distinct; ``columns`` names what comes from which."""
    own = other.select(F.col(key), *[F.col(theirs).alias(f"__{ours}") for ours, theirs in columns.items()])
    filled = {ours: F.coalesce(F.col(ours), F.col(f"__{ours}")) for ours in columns}
    return rows.join(own, key, "left").withColumns(filled).select(*rows.columns)


def with_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it has not, one of each key, the least; rows with a null key are not added."""
    rows = new.where(" and ".join(f"`{k}` is not null" for k in keys)).join(old.select(*keys), keys, "left_anti")
    others = [c for c in old.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("row")) if others else rows.select(*keys).distinct()
    return old.unionByName(one.select(*[F.col(f"row.{c}") if c in others else c for c in old.columns]))


def split_valid(rows: DataFrame, errors: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the others with ``error``, the name of their first one."""
    error = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in errors.items()])
    marked = rows.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def write_version(table: DataFrame, root: str, partitions: list[str] | None = None) -> str:
    """Writes a table's next version beside the others and gives its path; readers go on with the one they have."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    writer = table.write
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return path


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
