"""The classification dictionary: lists, the tree, search within the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions.conditions import any_contains, code_prefix
from vellum.functions.text import trimmed
from vellum.operators.listing import page

PATH = ["section", "class_code", "subclass", "main_group", "subgroup"]


def entries(raw: DataFrame, code: str | None, *columns: str) -> DataFrame:
    """Rows of a dictionary with the normalized code, its path and its level; rows without a valid code go. Without ``code``, ``code_norm`` is there already."""
    rows = (raw.withColumn("code_norm", codes.normalized(F.col(code))) if code else raw).where("code_norm is not null")
    norm = F.col("code_norm")
    parts = [f(norm).alias(n) for f, n in ((codes.section, "section"), (codes.class_code, "class_code"), (codes.subclass, "subclass"), (codes.main_group, "main_group"), (codes.subgroup, "subgroup"))]
    return rows.select("code_norm", codes.displayed(norm).alias("code"), *parts, codes.depth(norm).alias("level"), *columns)


def order(by_number: bool = False) -> list[Column]:
    """Order along the path; main groups as numbers or as text."""
    group = F.expr("try_cast(main_group as int)") if by_number else F.col("main_group")
    return [F.col(c).asc_nulls_last() if c != "main_group" else group.asc_nulls_last() for c in PATH] + [F.col("code_norm")]


def matching(dictionary: DataFrame, query: str) -> DataFrame:
    """Entries whose code begins with the query, or whose code, source code or titles have it in them; ``is_prefix`` marks the former."""
    prefix = code_prefix(F.col("code_norm"), query)
    texts = [F.col(c) for c in ("code", "source_code", "title_en", "title_zh") if c in dictionary.columns]
    return dictionary.withColumn("is_prefix", prefix).where(prefix | F.coalesce(any_contains(texts, query), F.lit(False)))


def children(dictionary: DataFrame, parent: str | None = None) -> DataFrame:
    """Entries one level below a code; without one, the sections."""
    if parent is None:
        return dictionary.where(F.col("level") == 0).where(F.col("code_norm").rlike(r"^[A-Z]\z"))
    return dictionary.where(codes.parent(F.col("code_norm")) == parent)


def node(rows: DataFrame, is_match: Column) -> DataFrame:
    """Entries as nodes of the tree."""
    norm = F.col("code_norm")
    below = F.col("main_group").isNull() | (F.col("subgroup") == "00")
    return rows.select("code_norm", "code", codes.parent(norm).alias("parent"), F.col("level").alias("depth"), below.alias("has_children"), is_match.alias("is_match"), *[c for c in rows.columns if c.startswith("title")])


def tree_search(dictionary: DataFrame, query: str, most: int = 200) -> DataFrame:
    """The first matches and all codes above them, as nodes of the tree."""
    found = matching(dictionary, query).orderBy(F.col("is_prefix").desc(), *order()).limit(most).select("code_norm")
    above = found.select(F.explode(codes.ancestors(F.col("code_norm"))).alias("code_norm"))
    marked = found.withColumn("hit", F.lit(True)).unionByName(above.withColumn("hit", F.lit(False)))
    marked = marked.groupBy("code_norm").agg(F.max("hit").alias("hit"))
    return node(dictionary.join(marked, "code_norm"), F.col("hit"))


#: Columns of an entry in a key-value store, and what they are where a value has none.
STORED = {"code": None, "source_code": "", "version": "", "section": None, "class_code": None, "subclass": None, "main_group": None, "subgroup": None, "level": None, "title_en": "", "title_zh": None, "title_zh_source": None, "source_file": None}


def stored_entries(values: DataFrame, value: str = "value") -> DataFrame:
    """Entries of JSON values of a key-value store; values that are no JSON or have no code go, what others lack has its default."""
    row = F.from_json(value, "code_norm string, " + ", ".join(f"{c} string" for c in STORED))
    rows = values.select(row.alias("row")).select("row.*").where("code_norm is not null and code_norm <> ''")
    level = F.regexp_extract("level", r"^\s*([+-]?\d+)", 1).try_cast("int")
    filled = {c: F.coalesce(c, F.lit(default)) for c, default in STORED.items() if default is not None}
    return rows.withColumns({"code": F.coalesce("code", "code_norm"), "level": level, **filled})


def _stored_matches(query: str) -> tuple[Column, Column]:
    """Whether the query, normalized, begins an entry's code, and whether it is in its codes or titles, signs for themselves and whatever the case."""
    wanted, norm = F.lit(query.strip()), codes.normalized(F.lit(query.strip()))
    prefix = F.coalesce(F.lower("code_norm").startswith(F.lower(norm)), F.lit(False))
    inside = [F.coalesce(F.lower(c).contains(F.lower(wanted)), F.lit(False)) for c in ("code", "source_code", "title_en", "title_zh")]
    return prefix, inside[0] | inside[1] | inside[2] | inside[3]


def stored_list(entries: DataFrame, query: str | None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of stored entries that match, those first whose code the query begins; groups in the order of numbers."""
    if query is None or not query.strip():
        return page(entries, order(by_number=True), number, size)
    prefix, inside = _stored_matches(query)
    return page(entries.where(prefix | inside), [prefix.desc(), *order(by_number=True)], number, size)


def stored_children(entries: DataFrame, parent: str | None = None, most: int = 100) -> DataFrame:
    """Stored entries one level below a code as nodes, at most 200; without one the sections A to H."""
    if parent is None:
        rows = entries.where(F.col("code_norm").rlike(r"^[A-H]\z"))
    else:
        norm = codes.normalized(F.lit(parent))
        at = lambda part, column: part(norm) == F.col(column)
        section = (F.length(norm) == 1) & at(codes.section, "section") & F.col("code_norm").rlike(r"^[A-Z]\d{2}\z")
        own_class = (F.length(norm) == 3) & at(codes.class_code, "class_code") & F.col("code_norm").rlike(r"^[A-Z]\d{2}[A-Z]\z")
        group = codes.main_group(norm)
        subclass = group.isNull() & at(codes.subclass, "subclass") & (F.col("main_group") != "") & (F.col("subgroup") == "00")
        main = (codes.subgroup(norm) == "00") & at(codes.subclass, "subclass") & (F.col("main_group") == group) & (F.col("subgroup") != "") & (F.col("subgroup") != "00")
        rows = entries.where(F.coalesce(section, F.lit(False)) | F.coalesce(own_class, F.lit(False)) | F.coalesce(subclass, F.lit(False)) | F.coalesce(main, F.lit(False)))
    some = page(rows, order(by_number=True), 1, most, 200)
    return node(some, F.lit(False))


def stored_tree_search(entries: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """All stored entries that match and all above them, as nodes; and one row, ``total``, the number of matches."""
    norm = codes.normalized_or_compact(F.lit(query.strip()))
    _, inside = _stored_matches(query)
    found = entries.where(F.lower("code_norm").startswith(F.lower(norm)) | inside).select("code_norm").distinct()
    above = found.select(F.explode(codes.ancestors(F.col("code_norm"))).alias("code_norm"))
    marked = found.withColumn("hit", F.lit(True)).unionByName(above.withColumn("hit", F.lit(False))).groupBy("code_norm").agg(F.max("hit").alias("hit"))
    return node(entries.join(marked, "code_norm"), F.col("hit")), found.agg(F.count("*").alias("total"))


def merged_titles(rows: DataFrame, key: str, title: str, position: str) -> DataFrame:
    """One row a key, the first by position; its title and those of later rows are joined by semicolons, each once."""
    others = [c for c in rows.columns if c not in (key, title, position)]
    first = rows.groupBy(key, title).agg(F.min(position).alias("at"), F.min_by(F.struct(*others), position).alias("row") if others else F.lit(None).alias("row"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", title))).alias("all"), F.min_by("row", "at").alias("row"))
    said = F.transform("all", lambda x: x[title])
    parts = lambda text: F.filter(F.transform(F.split(text, "; "), trimmed), lambda t: t != "")
    more = lambda text, t: F.array_join(F.when(F.array_contains(parts(text), t), parts(text)).otherwise(F.concat(parts(text), F.array(t))), "; ")
    merged = F.aggregate(F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), said[0], more)
    return listed.select(key, merged.alias(title), *([f"row.{c}" for c in others]))
