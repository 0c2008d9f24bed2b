"""Lists and records: parents with their children nested, in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page of ordered rows; page and size are brought into their range. Only a page's rows are kept in any task."""
    number, size = max(1, number), min(max(1, size), most)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def newest_first(dates: list[Column], created: Column, ties: Column) -> list[Column]:
    """Order of a list: by the first date that a row has, latest first and rows without one last, then by the time of creation; ``ties`` makes it whole."""
    return [F.coalesce(*dates).desc_nulls_last(), created.desc(), ties.asc()]


def total_pages(total: int, size: int) -> int:
    return -(-total // size)


def nested(children: DataFrame, key: str, fields: list[str], name: str, present: Column | None = None) -> DataFrame:
    """For each ``key`` the distinct children as one sorted array ``name``; children that are not ``present`` do not count."""
    entry = F.struct(*fields) if len(fields) > 1 else F.col(fields[0])
    if present is not None:
        entry = F.when(present, entry)
    return children.groupBy(key).agg(F.array_sort(F.collect_set(entry)).alias(name))


def nested_lists(children: DataFrame, key: str, lists: dict[str, tuple[list[str], Column | None]]) -> DataFrame:
    """Several arrays of one child table in one pass: for each name its fields, and which children count."""

    def distinct(fields: list[str], present: Column | None) -> Column:
        entry = F.struct(*fields) if len(fields) > 1 else F.col(fields[0])
        return F.array_sort(F.collect_set(entry if present is None else F.when(present, entry)))

    return children.groupBy(key).agg(*[distinct(*x).alias(name) for name, x in lists.items()])


def with_nested(parents: DataFrame, key: str, *lists: DataFrame) -> DataFrame:
    """``parents`` with the arrays of several child tables; empty where a parent has none.

    Every child table is reduced to one row a key before it is joined, so the joins multiply nothing.
    """
    for one in lists:
        names = [c for c in one.columns if c != key]
        parents = parents.join(one, key, "left").withColumns({name: F.coalesce(name, F.array()) for name in names})
    return parents


#: Columns of a list's item; of these the ones that are null rather than empty, and the list that is empty rather than null.
ITEM, ITEM_DATES, ITEM_LISTS = ("id", "doc_number", "kind", "title", "pub_date", "grant_date", "applicants"), ("pub_date", "grant_date"), ("applicants",)


def list_items(patents: DataFrame) -> DataFrame:
    """Patents as items of a list: their first columns, dates that are empty as null, applicants that are null as none."""
    text = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    shown = {c: text(c) for c in ITEM_DATES} | {c: F.coalesce(c, F.array()) for c in ITEM_LISTS}
    return patents.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in ITEM])


def with_assets(images: DataFrame, assets: DataFrame, shared: list[str]) -> DataFrame:
    """``images`` with the columns that assets have too taken from the asset, if it has them."""
    a, b = images.alias("i"), assets.alias("a")
    kept = [F.col(f"i.{c}") for c in images.columns if c not in shared]
    return a.join(b, F.col("i.asset_id") == F.col("a.id"), "left").select(*kept, *[F.coalesce(f"a.{c}", f"i.{c}").alias(c) for c in shared])


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the order of names as a reader sorts them, whatever the case and accents."""
    return rows.orderBy(F.collate(F.col(name), "UNICODE"), name)
