"""Queries of patent search: conditions, lists, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions import conditions as C
from vellum.functions import text as T
from vellum.operators import listing as L
from vellum.plans.tables import CODED_SQL, coded, patents, table

DATE = "strftime(o_orderdate, '%Y-%m-%d')"


def boolean_search(spark, sf_dir):
    """Title or abstract with two words, or one of two others; not one kind."""
    p = patents(spark, sf_dir)
    either = lambda v: C.any_contains([F.col("title"), F.col("abstract")], v)
    hit = (either("the") & either("under")) | ((either("license") | either("data")) & ~C.contains(F.col("kind"), "fr"))
    return p.where(hit).select("doc_id", "kind", "batch_id")


def flagship(spark, sf_dir):
    """Boolean search over patents with their distinct labels nested, newest first."""
    hits = boolean_search(spark, sf_dir)
    labels = L.nested(table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"], "labels")
    return L.page(L.with_nested(hits, "doc_id", labels), [F.desc("doc_id")], 1, 20)


def wildcards(spark, sf_dir):
    """Wildcards stand for characters, all other signs for themselves."""
    parts = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return parts.where(C.contains(name, "l*e r?ng") | C.contains(name, "50%") | C.contains(name, "a_b") | C.contains(name, "blue")).select("p_partkey", "p_name")


def _coded_orders(spark, sf_dir):
    """Orders as patents: their customers as applicants, and a classification code each, as written and normalized."""
    orders = table(spark, sf_dir, "orders")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    ipc = coded(spark, sf_dir).select("o_orderkey", F.col("raw_code").alias("ipc_code"), codes.normalized(F.col("raw_code")).alias("code_norm"))
    return orders, orders.select("o_orderkey", "o_custkey").join(names, "o_custkey").select("o_orderkey", "name"), ipc


def unescaped_search(spark, sf_dir):
    """The search box: percent and underscore are wildcards; texts, applicants' names, or codes as written without their spaces."""
    orders, names, ipc = _coded_orders(spark, sf_dir)
    found = C.free_search_each(orders, "o_orderkey", ["o_orderpriority", "o_orderstatus"], names, ipc, ["1%ent", "_00011", "b02 d 5/"])
    return found.select("o_orderkey", "asked")


def exists_field(spark, sf_dir):
    """Orders with a returned item or a high price: the flag serves a disjunction."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    marked = C.has_child(orders, items, "o_orderkey", F.col("l_returnflag") == "R", "returned")
    return marked.where(F.col("returned") | (F.col("o_totalprice") > 400000)).select("o_orderkey", "returned")


def not_exists(spark, sf_dir):
    """Orders without a large item."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return C.without_child(orders, items, "o_orderkey", F.col("l_quantity") > 30).select("o_orderkey", "o_orderpriority")


def default_field(spark, sf_dir):
    """A value without a field: texts of the patent, names of its children, or a code with it, normalized, in it."""
    orders, names, ipc = _coded_orders(spark, sf_dir)
    found = C.default_field_each(orders, "o_orderkey", ["o_orderpriority", "o_orderstatus"], [names], ipc, ["urgent", "00011", "b02d 5/00", "A01B0010020000"])
    return found.select("o_orderkey", "asked")


def code_field(spark, sf_dir):
    """Patents with a code that begins with a value, however it is written."""
    orders, _, ipc = _coded_orders(spark, sf_dir)
    found = [C.with_child(orders, ipc, "o_orderkey", C.code_prefix(F.col("code_norm"), v)).select("o_orderkey", F.lit(v).alias("asked")) for v in ("h04", "A02 c 12", "E05H0016000000", "C?3*/04")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def json_fields(spark, sf_dir):
    """Claims and descriptions are searched as JSON text: keys and escapes take part."""
    p = patents(spark, sf_dir)
    description = F.struct(F.col("title").alias("technical_field"), F.col("kind").alias("embodiment"))
    hit = C.contains(C.json_text(description), 'embodiment":"en"') & ~C.contains(C.json_text(F.col("title")), "the")
    return p.where(hit).select("doc_id")


def agent_field(spark, sf_dir):
    """Orders of customers whose name or segment has a value: agents by agency or by name."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return C.with_child(orders, customers, "o_custkey", C.agent_contains(F.col("c_mktsegment"), F.col("c_name"), "build?ng") | C.agent_contains(F.col("c_mktsegment"), F.col("c_name"), "00007")).select("o_orderkey")


def _dated(value):
    def query(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").where(C.on_date(F.col("o_orderdate"), value))  # the column itself, so that it reaches the scan
        return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"))

    query.__doc__ = f"Orders on {value}, dates as text."
    return query


def range_and_equality(spark, sf_dir):
    hit = (F.col("o_orderstatus") == "F") & C.in_range(F.col("o_orderdate"), "1996-02-01", "1997-12-31")
    return table(spark, sf_dir, "orders").where(hit).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"), "o_orderstatus")


def province_semi(spark, sf_dir):
    """Orders of customers of one segment."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return C.with_child(orders, customers, "o_custkey", F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "o_custkey")


def list_page(spark, sf_dir):
    """The third page of orders by the first date that they have, newest first, each with the flags of its items."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    published, granted = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    one = L.page(orders, L.newest_first([published, granted], F.col("o_totalprice"), F.col("o_orderkey")), 3, 25)
    flags = L.nested(items.join(one.select("o_orderkey"), "o_orderkey", "left_semi"), "o_orderkey", ["l_returnflag"], "flags")
    return L.with_nested(one, "o_orderkey", flags).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.array_join("flags", ",").alias("flags"))


def detail_nested(spark, sf_dir):
    """Orders with two lists of one child table, made in one pass over it."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    lists = L.nested_lists(items, "o_orderkey", {"flags": (["l_returnflag"], None), "statuses": (["l_linestatus"], F.col("l_quantity") > 40)})
    found = L.with_nested(orders, "o_orderkey", lists)
    return found.select("o_orderkey", T.joined_names(F.col("flags")).alias("flags"), T.joined_names(F.col("statuses")).alias("statuses"))


def left_join_coalesce(spark, sf_dir):
    """Images with what their asset says, and what they say themselves where it says nothing; documents stand for images, labels for assets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("asset_id"), F.col("lang").alias("role"), F.lit(-1).alias("quality"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    assets = labels.withColumn("role", F.when(F.col("quality") == 1, "good"))
    return L.with_assets(docs, assets, ["quality", "role"]).select("doc_id", "quality", "role")


def free_text_page(spark, sf_dir):
    """A page of patents by the length of title, with the number of all hits."""
    p = patents(spark, sf_dir).where(C.contains(F.col("abstract"), "the"))
    total = p.agg(F.count("*").alias("total"))
    return L.page(p, [F.desc(F.length("title")), F.col("doc_id")], 2, 10).crossJoin(total).select("doc_id", "total")


QUERIES = {
    "expr_boolean_search": boolean_search,
    "expr_wildcard_escape": wildcards,
    "expr_exists_field": exists_field,
    "expr_not_exists": not_exists,
    "expr_default_field": default_field,
    "expr_code_field": code_field,
    "expr_json_fields": json_fields,
    "expr_agent_field": agent_field,
    "expr_date_year": _dated("1996"),
    "expr_date_month": _dated("1997-12"),
    "expr_date_day": _dated("1998-03-05"),
    "free_search_unescaped": unescaped_search,
    "filter_range_and_equality": range_and_equality,
    "province_semi": province_semi,
    "list_page": list_page,
    "list_with_total": free_text_page,
    "detail_nested": detail_nested,
    "left_join_coalesce": left_join_coalesce,
}

_CODED = f"with {CODED_SQL}, o as (select o.*, c_name as name, raw_code as ipc_code, code_norm from orders o left join customer on c_custkey = o_custkey join leveled l on l.o_orderkey = o.o_orderkey)"
_EITHER = "(substr(text, 1, case when strpos(text, chr(10)) = 0 then length(text) else strpos(text, chr(10)) - 1 end) ilike '%{0}%' or text ilike '%{0}%')"

ORACLE_SQL = {
    "expr_boolean_search": f"select doc_id, lang as kind, source as batch_id from documents where ({_EITHER.format('the')} and {_EITHER.format('under')}) or (({_EITHER.format('license')} or {_EITHER.format('data')}) and not lang ilike '%fr%')",
    "expr_wildcard_escape": r"select p_partkey, p_name from part where p_name ilike '%l%e r_ng%' escape '\' or p_name ilike '%50\%%' escape '\' or p_name ilike '%a\_b%' escape '\' or p_name ilike '%blue%'",
    "expr_exists_field": "select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') or o_totalprice > 400000",
    "expr_not_exists": "select o_orderkey, o_orderpriority from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30)",
    "expr_default_field": f"{_CODED} select o_orderkey, v as asked from o cross join (values ('urgent', 'URGENT'), ('00011', '00011'), ('b02d 5/00', 'B02D5/00'), ('A01B0010020000', 'A01B10/02')) as t(v, c) where o_orderpriority ilike '%' || v || '%' or o_orderstatus ilike '%' || v || '%' or name ilike '%' || v || '%' or code_norm ilike '%' || c || '%'",
    "expr_code_field": f"{_CODED} select o_orderkey, v as asked from o cross join (values ('h04', 'H04%'), ('A02 c 12', 'A02C12%'), ('E05H0016000000', 'E05H16/00%'), ('C?3*/04', 'C_3%/04%')) as t(v, c) where code_norm ilike c",
    "expr_json_fields": "select doc_id from documents where lower(lang) = 'en' and not substr(text, 1, case when strpos(text, chr(10)) = 0 then length(text) else strpos(text, chr(10)) - 1 end) ilike '%the%'",
    "expr_agent_field": "select o_orderkey from orders join customer on c_custkey = o_custkey where c_mktsegment ilike '%build_ng%' or c_name ilike '%build_ng%' or c_mktsegment ilike '%00007%' or c_name ilike '%00007%'",
    "expr_date_year": f"select o_orderkey, {DATE} as pub_date from orders where {DATE} >= '1996-01-01' and {DATE} < '1997-01-01'",
    "expr_date_month": f"select o_orderkey, {DATE} as pub_date from orders where {DATE} >= '1997-12-01' and {DATE} < '1998-01-01'",
    "expr_date_day": f"select o_orderkey, {DATE} as pub_date from orders where {DATE} = '1998-03-05'",
    "free_search_unescaped": f"{_CODED} select o_orderkey, v as asked from o cross join (values ('1%ent'), ('_00011'), ('b02 d 5/')) as t(v) where o_orderpriority ilike '%' || v || '%' or o_orderstatus ilike '%' || v || '%' or name ilike '%' || v || '%' or replace(ipc_code, ' ', '') ilike '%' || replace(v, ' ', '') || '%'",
    "filter_range_and_equality": f"select o_orderkey, {DATE} as pub_date, o_orderstatus from orders where o_orderstatus = 'F' and {DATE} between '1996-02-01' and '1997-12-31'",
    "province_semi": "select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')",
    "list_page": f"with one as (select * from orders order by case when o_orderstatus = 'F' or o_orderkey % 3 = 0 then o_orderdate end desc nulls last, o_totalprice desc, o_orderkey limit 25 offset 50) select o_orderkey, {DATE} as day, coalesce((select string_agg(distinct l_returnflag, ',' order by l_returnflag) from lineitem where l_orderkey = o_orderkey), '') as flags from one",
    "list_with_total": "with p as (select doc_id, length(substr(text, 1, case when strpos(text, chr(10)) = 0 then length(text) else strpos(text, chr(10)) - 1 end)) as n from documents where text ilike '%the%') select doc_id, (select count(*) from p) as total from p order by n desc, doc_id limit 10 offset 10",
    "detail_nested": "select o_orderkey, coalesce((select string_agg(distinct l_returnflag, '; ' order by l_returnflag) from lineitem where l_orderkey = o_orderkey), '-') as flags, coalesce((select string_agg(distinct l_linestatus, '; ' order by l_linestatus) from lineitem where l_orderkey = o_orderkey and l_quantity > 40), '-') as statuses from orders",
    "left_join_coalesce": "select d.doc_id, coalesce(quality, -1) as quality, coalesce(case when quality = 1 then 'good' end, lang) as role from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on d.doc_id = l.doc_id",
}
