"""Queries over classification codes and the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions import text as T
from vellum.operators import classification as C
from vellum.plans.tables import CODED_SQL, coded, dictionary, table


def normalize(spark, sf_dir):
    norm = codes.normalized(F.col("raw_code"))
    return coded(spark, sf_dir).select("o_orderkey", norm.alias("code_norm"), codes.displayed(norm).alias("code"))


def split(spark, sf_dir):
    rows = coded(spark, sf_dir).withColumn("n", codes.normalized(F.col("raw_code")))
    n = F.col("n")
    return rows.select("o_orderkey", codes.section(n).alias("section"), codes.class_code(n).alias("class_code"), codes.subclass(n).alias("subclass"), codes.main_group(n).alias("main_group"), codes.subgroup(n).alias("subgroup"))


def parent_depth(spark, sf_dir):
    rows = coded(spark, sf_dir).withColumn("n", codes.normalized(F.col("raw_code")))
    return rows.select("o_orderkey", codes.depth(F.col("n")).alias("depth"), codes.parent(F.col("n")).alias("parent"), codes.depth_label(F.col("n")).alias("label"))


def ancestors(spark, sf_dir):
    rows = coded(spark, sf_dir).withColumn("n", codes.normalized(F.col("raw_code")))
    return rows.select("o_orderkey", F.array_join(codes.ancestors(F.col("n")), ">").alias("path"))


def class_list(spark, sf_dir):
    """Second page of the entries that match a query, prefixes first."""
    found = C.matching(dictionary(spark, sf_dir), "A03")
    return found.orderBy(F.col("is_prefix").desc(), *C.order()).offset(10).limit(10).select("code_norm", "code", "is_prefix")


def class_list_titles(spark, sf_dir):
    return C.matching(dictionary(spark, sf_dir), "urgent").select("code_norm", "title_en", "is_prefix")


def tree_sections(spark, sf_dir):
    return C.node(C.children(dictionary(spark, sf_dir)), F.lit(False))


def tree_children(spark, sf_dir):
    """Nodes below a class, and below a main group of each kind."""
    d = dictionary(spark, sf_dir)
    below = C.children(d, "C03").unionByName(C.children(d, "D04C")).unionByName(C.children(d, "E05")).dropDuplicates(["code_norm"])
    return C.node(below, F.lit(False)).select("code_norm", "parent", "depth", "has_children")


def tree_search(spark, sf_dir):
    return C.tree_search(dictionary(spark, sf_dir), "B02", 50).select("code_norm", "parent", "depth", "is_match")


def merged_titles(spark, sf_dir):
    """Distinct roles of a conversation in the order of their first turn."""
    return C.merged_titles(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), "conv_id", "role", "turn")


def embedding_document(spark, sf_dir):
    """Texts of the dictionary's entries that are to be embedded, with titles of one language, the other, or both."""
    d = dictionary(spark, sf_dir)
    d = d.withColumns({"version": F.lit("2026.01"), "title_zh": F.when(F.col("level") % 2 == 0, F.concat(F.lit(" 标题\u3000"), "code", F.lit(" ")))})
    entry = {c: F.col(c) for c in ("code", "code_norm", "version", "title_zh", "title_en", *C.PATH)}
    texts = {locale: T.embedding_document(entry, "ipc", codes.depth_label(F.col("code_norm")), locale) for locale in ("mixed", "zh", "en")}
    return d.select("code_norm", *[F.sha2(text, 256).alias(f"{locale}_hash") for locale, text in texts.items()], texts["mixed"].alias("content"))


QUERIES = {
    "code_normalize": normalize,
    "code_split": split,
    "code_parent_depth": parent_depth,
    "code_ancestors": ancestors,
    "class_list": class_list,
    "class_list_titles": class_list_titles,
    "class_tree_sections": tree_sections,
    "class_tree_children": tree_children,
    "class_tree_search": tree_search,
    "merge_title_fold": merged_titles,
    "embedding_document": embedding_document,
}

_SHOWN = "case when code_norm like '%/%' then concat(substr(code_norm, 1, 4), ' ', substr(code_norm, 5)) else code_norm end"
_PARENT = "case level when 1 then substr(code_norm, 1, 1) when 2 then substr(code_norm, 1, 3) when 3 then substr(code_norm, 1, 4) when 4 then concat(split_part(code_norm, '/', 1), '/00') end"
_GROUP = "case when code_norm like '%/%' then substr(split_part(code_norm, '/', 1), 5) end"
_SUB = "case when code_norm like '%/%' then split_part(code_norm, '/', 2) end"
_BELOW = "(code_norm not like '%/%' or code_norm like '%/00')"
_ORDER = f"substr(code_norm, 1, 1), case when length(code_norm) > 2 then substr(code_norm, 1, 3) end nulls last, case when length(code_norm) > 3 then substr(code_norm, 1, 4) end nulls last, {_GROUP} nulls last, {_SUB} nulls last, code_norm"

ORACLE_SQL = {
    "code_normalize": f"with {CODED_SQL} select o_orderkey, code_norm, {_SHOWN} as code from leveled",
    "code_split": f"with {CODED_SQL} select o_orderkey, substr(code_norm, 1, 1) as section, case when length(code_norm) > 2 then substr(code_norm, 1, 3) end as class_code, case when length(code_norm) > 3 then substr(code_norm, 1, 4) end as subclass, {_GROUP} as main_group, {_SUB} as subgroup from leveled",
    "code_parent_depth": f"with {CODED_SQL} select o_orderkey, level as depth, {_PARENT} as parent, case level when 0 then 'section' when 1 then 'class' when 2 then 'subclass' when 3 then 'main_group' else 'subgroup' end as label from leveled",
    "code_ancestors": f"with {CODED_SQL} select o_orderkey, concat_ws('>', case when level > 0 then substr(code_norm, 1, 1) end, case when level > 1 then substr(code_norm, 1, 3) end, case when level > 2 then substr(code_norm, 1, 4) end, case when level > 3 then concat(split_part(code_norm, '/', 1), '/00') end) as path from leveled",
    "class_list": f"with {CODED_SQL}, shown as (select *, {_SHOWN} as code from dictionary) select code_norm, code, code_norm like 'A03%' as is_prefix from shown where code_norm like 'A03%' or code ilike '%A03%' or title_en ilike '%A03%' order by is_prefix desc, {_ORDER} limit 10 offset 10",
    "class_list_titles": f"with {CODED_SQL} select code_norm, title_en, code_norm like 'URGENT%' as is_prefix from dictionary where title_en ilike '%urgent%'",
    "class_tree_sections": f"with {CODED_SQL} select code_norm, code_norm as code, cast(null as varchar) as parent, level as depth, true as has_children, false as is_match, title_en from dictionary where level = 0",
    "class_tree_children": f"with {CODED_SQL} select code_norm, {_PARENT} as parent, level as depth, {_BELOW} as has_children from dictionary where {_PARENT} in ('C03', 'D04C', 'E05')",
    "class_tree_search": f"with {CODED_SQL}, hits as (select code_norm, level, {_SHOWN} as code from dictionary where code_norm like 'B02%' or {_SHOWN} ilike '%B02%' or title_en ilike '%B02%' order by (code_norm like 'B02%') desc, {_ORDER} limit 50), above as (select unnest([substr(code_norm, 1, 1), substr(code_norm, 1, 3), substr(code_norm, 1, 4), concat(split_part(code_norm, '/', 1), '/00')]) as code_norm, unnest([0, 1, 2, 3]) as up, level from hits) select code_norm, {_PARENT} as parent, level as depth, code_norm in (select code_norm from hits) as is_match from dictionary where code_norm in (select code_norm from hits) or code_norm in (select code_norm from above where up < level)",
    "merge_title_fold": "select conv_id, string_agg(role, '; ' order by first_turn, role) as role from (select conv_id, role, min(turn) as first_turn from conversations group by conv_id, role) group by conv_id",
    "embedding_document": f"with {CODED_SQL}, e as (select *, {_SHOWN} as code, case when level % 2 = 0 then concat(chr(10), '中文标题：标题 ', {_SHOWN}) else '' end as zh, concat(chr(10), '英文标题：', title_en) as en from dictionary), c as (select code_norm, concat('分类类型：IPC', chr(10), '分类号：', code, chr(10), '规范分类号：', code_norm, chr(10), '版本：2026.01', chr(10), '层级：', case level when 0 then 'section' when 1 then 'class' when 2 then 'subclass' when 3 then 'main_group' else 'subgroup' end) as head, zh, en, concat(chr(10), '结构字段：section=', substr(code_norm, 1, 1), case when level > 0 then concat(' class=', substr(code_norm, 1, 3)) else '' end, case when level > 1 then concat(' subclass=', substr(code_norm, 1, 4)) else '' end, case when level > 2 then concat(' main_group=', {_GROUP}, ' subgroup=', {_SUB}) else '' end) as parts from e) select code_norm, sha256(concat(head, zh, en, parts)) as mixed_hash, sha256(concat(head, zh, parts)) as zh_hash, sha256(concat(head, en, parts)) as en_hash, concat(head, zh, en, parts) as content from c",
}
