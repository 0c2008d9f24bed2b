"""Queries of batches, images, patent texts and stored dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions import patent_text as P
from vellum.operators import batches as B
from vellum.operators import classification as C
from vellum.operators import images as I
from vellum.operators import listing as L
from vellum.operators import merge as M
from vellum.plans.tables import CODED_SQL, dealt, dictionary, table


def batch_changes(spark, sf_dir):
    states = F.array(*map(F.lit, B.STATES))
    return table(spark, sf_dir, "events").withColumn("status", F.element_at(states, (F.col("event_id") % 8 + 1).cast("int")))


def batch_states(spark, sf_dir):
    """The state of each user's last change, and when it was started and ended."""
    rows = B.current(batch_changes(spark, sf_dir), "user_id", "status", "ts", "event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("user_id", "status", day("started_at").alias("started_at"), day("completed_at").alias("completed_at"))


def batches_active(spark, sf_dir):
    return B.listed(B.current(batch_changes(spark, sf_dir), "user_id", "status", "ts", "event_id"), "pending", active=True).groupBy("status").agg(F.count("*").alias("batches"))


def log_failures(spark, sf_dir):
    """Failures in the details of log entries, by shape."""
    events = table(spark, sf_dir, "events")
    number, file = F.struct(F.col("event_type").alias("patent_number"), F.lit("e").alias("error")), F.struct(F.col("event_type").alias("file"), F.lit("r").alias("reason"))
    details = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.array(number, number).alias("failures")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.array(file).alias("failures")))).otherwise(F.col("props"))
    return B.failures(events.withColumn("details", details)).groupBy("event_type", "kind_of_failure").agg(F.count("*").alias("failures"))


def time_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", B.seconds_left(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") % 7).cast("long").alias("seconds"))


def resume_archives(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit(1).alias("version"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("modified"))
    return B.unfinished(rows, rows.where("size % 2 = 0")).groupBy("name").agg(F.count("*").alias("archives"))


def reconcile(spark, sf_dir):
    """States of batches by what is found for them; orders are batches, their items the files."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    batches = orders.select(key.alias("batch"), F.element_at(F.array(*map(F.lit, B.STATES)), (key % 8 + 1).cast("int")).alias("status"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.count_if(F.col("l_quantity") > 25).alias("files"))
    k = F.col("batch")
    found = items.where(k % 5 > 0).select("batch", "files", F.when(k % 3 == 0, k % 4).alias("parsed"), (k % 6).alias("imported"), (k % 7 == 0).alias("extracted"), (k % 2 == 0).alias("whole"))
    return B.reconciled(batches, found)


def image_references(spark, sf_dir):
    """References, files that none names, and the abstract's figure."""
    parts = table(spark, sf_dir, "part")
    file = lambda c, ext: F.concat(c, F.lit(ext))
    rows = parts.select("p_partkey", F.array(F.struct(file(F.col("p_name"), ".JPG").alias("file_name"), F.lit("inline").alias("image_role"))).alias("refs"), F.array(file(F.col("p_name"), ".jpg"), file(F.col("p_type"), ".tif")).alias("files"), F.when(F.col("p_partkey") % 2 == 0, file(F.col("p_brand"), ".png")).alias("figure"))
    return I.expanded(rows, "p_partkey", "refs", "files", "figure")


def image_entries(spark, sf_dir):
    """References joined to entries by name, case and folder aside."""
    parts, regions = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    refs = parts.select("p_partkey", F.concat(F.lit("dir\\"), F.lit("Nation"), F.col("p_size"), F.lit(".JPG")).alias("file_name"))
    entries = regions.select(F.concat(F.lit("x/nation"), "n_nationkey", F.lit(".jpg")).alias("entry_name"), "n_name")
    return I.with_entries(refs, entries).select("p_partkey", "image_key", "n_name")


def image_same_content(spark, sf_dir):
    """Each image with the first image of its patent that has the same content."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.col("p_size").alias("patent"), F.md5("p_name").alias("digest"), F.concat("p_partkey", F.lit(".jpg")).alias("file_name"))
    return I.same_content(rows, "patent", "digest")


def image_sections(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("source_section"), F.concat(F.lit("f"), "l_linenumber").alias("file_name"))
    return I.by_section(items, "l_orderkey")


def image_totals(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("state", F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("uploaded"))
    return I.totals(items)


def image_rotations(spark, sf_dir):
    """The abstract's figure against the drawings of a patent, in every rotation."""
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("patent"), F.col("p_partkey").cast("string").alias("file_name"))
    return I.candidates(parts, "patent", F.col("file_name").cast("int") <= 50).groupBy("patent", "rotation").agg(F.count("*").alias("pairs"), F.sum(F.col("drawing").cast("long")).alias("drawings"))


def disclosure(spark, sf_dir):
    """A disclosure of made-up paragraphs, marked in every order, cut into problem, solution and effect."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    lines = F.array_compact(F.array(
        F.when(k % 7 != 3, F.col("p_name")), F.when(k % 2 == 0, F.concat(F.lit("本发明所要解决的技术问题 "), "p_type")), F.when(k % 5 == 4, F.lit("与现有技术相比，早")),
        F.when(k % 3 > 0, F.concat(F.lit("采用如下技术方案 "), "p_type")), F.col("p_brand"), F.when(k % 5 < 3, F.lit("具有以下有益效果")),
    ))
    problem, solution, effect = P.disclosure_parts(F.col("lines"))
    return dealt(parts.select("p_partkey", lines.alias("lines")), "p_partkey").select("p_partkey", problem.alias("problem"), solution.alias("solution"), effect.alias("effect"))


def markers(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    text = F.concat(F.lit("a "), P.image_marker(F.concat("p_name", F.lit(".jpg"))), F.lit(" b [[PATENT_IMAGE:x.tif]] c [[PATENT_IMAGE:x.tif]]"))
    xml = F.concat(F.lit('<?xml version="1.0"?><a n="1" kind="'), F.lower(F.substring("p_brand", 1, 1)), F.lit('"><b kind="A"/> utility-model'))
    return parts.select("p_partkey", F.array_join(P.inline_images(text), ",").alias("files"), P.detected_type(xml).alias("type"))


def backfill(spark, sf_dir):
    """Labels take their language over from documents where they have none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("xx")).alias("lang"))
    return M.filled_from(labels, table(spark, sf_dir, "documents"), "doc_id", {"lang": "lang"})


def added_missing(spark, sf_dir):
    """Nations as assets, with those of customers' market segments added that are not among them."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("oss_key"), F.lit("nation").alias("content_hash"))
    c = table(spark, sf_dir, "customer")
    new = c.select(F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit("s"), F.col("c_nationkey"))).alias("oss_key"), F.concat(F.lit("h"), F.col("c_custkey") % 7).alias("content_hash"))
    return M.with_missing(nations, new.unionByName(nations.withColumn("content_hash", F.lit("other"))), ["oss_key"])


def batch_logs(spark, sf_dir):
    """The newest entries of a batch's log."""
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("batch_code"), F.col("ts").alias("created_at"))
    return B.newest_logs(logs, "click").select("id", "batch_code")


def batch_lookups(spark, sf_dir):
    """The newest batch of a folder; and how many files each batch has, and their bytes."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("batch_code"), F.col("event_type").alias("ftp_folder"), F.col("ts").alias("created_at"))
    latest = B.latest_of(events, "ftp_folder", "click").select("batch_code", F.lit(None).cast("long").alias("files"), F.lit(None).cast("long").alias("bytes"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("batch_code"), F.col("l_quantity").cast("long").alias("size"))
    return latest.unionByName(B.size_of(files, "batch_code"))


def patent_items(spark, sf_dir):
    """Orders as items of a list, with null for empty dates and no applicants for null."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    date = F.when(k % 3 > 0, F.when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(""))
    names = F.when(k % 4 > 0, F.array(F.struct(F.col("o_orderpriority").alias("name"))))
    rows = orders.select(k.alias("id"), k.cast("string").alias("doc_number"), F.col("o_orderstatus").alias("kind"), F.lit("t").alias("title"), date.alias("pub_date"), date.alias("grant_date"), names.alias("applicants"), "o_totalprice")
    return L.list_items(rows).select("id", "doc_number", "kind", "pub_date", "grant_date", F.array_join(F.transform("applicants", lambda a: a["name"]), ",").alias("applicants"))


def _stored_dictionary(spark, sf_dir):
    """The dictionary as JSON values of a key-value store, with one that is broken and some without all columns."""
    entries = dictionary(spark, sf_dir)
    full = F.to_json(F.struct("code_norm", "code", "section", "class_code", "subclass", "main_group", "subgroup", F.col("level").cast("string").alias("level"), "title_en"))
    rows = entries.select(full.alias("value"))
    return C.stored_entries(rows.unionByName(rows.limit(1).select(F.lit("{broken").alias("value"))).unionByName(rows.limit(1).select(F.lit('{"code": "x"}').alias("value"))))


def kv_list(spark, sf_dir):
    """The dictionary read from JSON values of a key-value store, groups ordered as numbers."""
    rows = _stored_dictionary(spark, sf_dir).where(F.col("code_norm").startswith("A"))
    return C.stored_list(rows, None, 1, 40).select("code_norm", codes.depth_label(F.col("code_norm")).alias("label"))


def kv_tree(spark, sf_dir):
    """The tree of a key-value store: the sections, what is below a section, a class, a subclass and a group, and a search with all codes above its matches."""
    rows = _stored_dictionary(spark, sf_dir)
    shown = lambda df, name: df.select(F.lit(name).alias("of"), "code_norm", "parent", "depth", "has_children", "is_match")
    out = shown(C.stored_children(rows, None), "top")
    for parent in ("A", "h09", "H09J", "E09D 15/00", "none"):
        out = out.unionByName(shown(C.stored_children(rows, parent, 200), parent))
    found, total = C.stored_tree_search(rows, "b02 d")
    out = out.unionByName(shown(found, "search"))
    return out.unionByName(total.select(F.lit("total").alias("of"), F.col("total").cast("string").alias("code_norm"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("boolean").alias("has_children"), F.lit(None).cast("boolean").alias("is_match")))


def child_rows(spark, sf_dir):
    """Exact repeats of child rows go."""
    return M.first_of_each(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], F.col("turn"))


QUERIES = {f.__name__: f for f in (batch_states, batches_active, log_failures, time_left, resume_archives, reconcile, image_references, image_entries, image_same_content, image_sections, image_totals, image_rotations, disclosure, markers, backfill, added_missing, batch_logs, batch_lookups, patent_items, kv_list, kv_tree, child_rows)}

_CHANGED = "c as (select *, list_extract(['pending', 'downloading', 'downloaded', 'processing', 'processed', 'importing', 'completed', 'failed'], cast(event_id % 8 + 1 as int)) as status from events), last as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from c) where rn = 1)"
_TIME = "'%Y-%m-%d %H:%M:%S'"

ORACLE_SQL = {
    "batch_states": f"with {_CHANGED}, s as (select user_id, min(ts) filter (status <> 'pending') as started from c group by user_id) select l.user_id, status, strftime(started, {_TIME}) as started_at, case when status in ('completed', 'failed') then strftime(ts, {_TIME}) end as completed_at from last l join s on l.user_id = s.user_id",
    "batches_active": f"with {_CHANGED} select status, count(*) as batches from last where status in ('downloading', 'processing', 'importing') group by status",
    "log_failures": "select event_type, case event_id % 3 when 0 then 'import' else 'file' end as kind_of_failure, cast(sum(case event_id % 3 when 0 then 2 else 1 end) as bigint) as failures from events where event_id % 3 < 2 group by 1, 2",
    "time_left": "select o_orderkey, case when o_custkey % 7 > 0 then cast(ceil(greatest(o_orderkey - o_custkey, 0) / cast(o_custkey % 7 as double)) as bigint) end as seconds from orders",
    "resume_archives": "select p_name as name, count(*) as archives from part where p_size % 2 <> 0 group by p_name",
    "reconcile": """with f as (select l_orderkey as b, count(*) filter (l_quantity > 25) as files from lineitem group by l_orderkey having l_orderkey % 5 > 0)
select o_orderkey as batch, list_extract(['pending', 'downloading', 'downloaded', 'processing', 'processed', 'importing', 'completed', 'failed'], cast(o_orderkey % 8 + 1 as int)) as previous,
case when o_orderkey % 8 = 6 then 'completed' when files is null then 'pending' when o_orderkey % 3 = 0 then case when o_orderkey % 4 > 0 and o_orderkey % 6 >= o_orderkey % 4 then 'completed' else 'processed' end when o_orderkey % 7 = 0 then 'downloaded' when files > 0 and o_orderkey % 2 = 0 then 'downloaded' else 'pending' end as status from orders left join f on b = o_orderkey""",
    "image_references": "select p_partkey, cast(0 as int) as sort_order, concat(p_name, '.JPG') as file_name, 'inline' as image_role from part union all select p_partkey, cast(1 as int), concat(p_type, '.tif'), 'drawing' from part union all select p_partkey, cast(2 as int), concat(p_brand, '.png'), 'abstract' from part where p_partkey % 2 = 0",
    "image_entries": "select p_partkey, concat('nation', p_size, '.jpg') as image_key, n_name from part left join nation on n_nationkey = p_size",
    "image_same_content": "with r as (select p_size as patent, p_name, concat(p_partkey, '.jpg') as file_name from part) select patent, file_name, min(file_name) over (partition by patent, p_name) as matched_file_name, cast(1.0 as double) as match_score, cast(0 as int) as display_rotation from r",
    "image_sections": "select l_orderkey, case when l_returnflag <> 'N' then l_returnflag else 'InventionMode' end as source_section, string_agg(distinct concat('f', l_linenumber), ',' order by concat('f', l_linenumber)) as files from lineitem group by 1, 2",
    "image_totals": "select count(*) as total, count(*) filter (l_returnflag not in ('R', 'A')) as uploaded, count(*) filter (l_returnflag = 'A') as skipped, count(*) filter (l_returnflag = 'R') as failed from lineitem",
    "image_rotations": "select a.p_size as patent, cast(r as int) as rotation, count(*) as pairs, cast(sum(d.p_partkey) as bigint) as drawings from part a join part d on a.p_size = d.p_size cross join unnest([0, 90, 180, 270]) as t(r) where a.p_partkey <= 50 and d.p_partkey > 50 group by 1, 2",
    "disclosure": """with l as (select p_partkey as k, list_filter([case when p_partkey % 7 <> 3 then p_name end, case when p_partkey % 2 = 0 then concat('本发明所要解决的技术问题 ', p_type) end, case when p_partkey % 5 = 4 then '与现有技术相比，早' end, case when p_partkey % 3 > 0 then concat('采用如下技术方案 ', p_type) end, p_brand, case when p_partkey % 5 < 3 then '具有以下有益效果' end], lambda x: x is not null) as p from part),
m as (select *, list_position(list_transform(p, lambda x: starts_with(x, '本发明')), true) as a, list_position(list_transform(p, lambda x: starts_with(x, '采用')), true) as b, list_position(list_transform(p, lambda x: starts_with(x, '与现有') or starts_with(x, '具有')), true) as c, len(p) + 1 as e from l),
n as (select *, nullif(coalesce(a, 0), 0) as a1, nullif(coalesce(b, 0), 0) as b1, nullif(coalesce(c, 0), 0) as c1 from m)
select k as p_partkey, case when a1 is not null then array_to_string(p[a1 : least(case when b1 > a1 then b1 else e end, case when c1 > a1 then c1 else e end) - 1], chr(10)) when b1 > 1 then array_to_string(p[1 : b1 - 1], chr(10)) end as problem,
case when b1 is not null then array_to_string(p[b1 : least(case when a1 > b1 then a1 else e end, case when c1 > b1 then c1 else e end) - 1], chr(10)) end as solution,
case when c1 is not null then array_to_string(p[c1 : least(case when a1 > c1 then a1 else e end, case when b1 > c1 then b1 else e end) - 1], chr(10)) end as effect from n""",
    "markers": "select p_partkey, concat(p_name, '.jpg,x.tif') as files, case substr(p_brand, 1, 1) when 'A' then 'invention_application' when 'B' then 'invention' else 'utility_model' end as type from part",
    "added_missing": "select n_name as oss_key, 'nation' as content_hash from nation union all select concat('s', c_nationkey), min(concat('h', c_custkey % 7)) from customer where c_custkey % 9 > 0 group by 1",
    "batch_logs": "select event_id as id, event_type as batch_code from events where event_type = 'click' order by ts desc, event_id desc limit 100",
    "batch_lookups": "(select cast(event_id as varchar) as batch_code, cast(null as bigint) as files, cast(null as bigint) as bytes from events where event_type = 'click' order by ts desc, cast(event_id as varchar) limit 1) union all select l_returnflag, count(*), cast(sum(cast(l_quantity as bigint)) as bigint) from lineitem group by 1",
    "patent_items": "select o_orderkey as id, cast(o_orderkey as varchar) as doc_number, o_orderstatus as kind, case when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') end as pub_date, case when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') end as grant_date, case when o_orderkey % 4 > 0 then o_orderpriority else '' end as applicants from orders",
    "kv_tree": f"""with {CODED_SQL}, p as (select code_norm, level, length(code_norm) as n, case when length(code_norm) > 3 then substr(code_norm, 1, 4) end as subclass, case when level >= 3 then split_part(code_norm, '/', 1) end as grp, case when level >= 3 then split_part(code_norm, '/', 2) end as sub, title_en from dictionary),
node as (select code_norm, case when level = 4 then concat(grp, '/00') when level = 3 then subclass when level = 2 then substr(code_norm, 1, 3) when level = 1 then substr(code_norm, 1, 1) end as parent, cast(level as int) as depth, grp is null or sub = '00' as has_children, level, subclass, grp, sub from p),
hit as (select code_norm from node where code_norm like 'B02D%' or lower(case when level >= 3 then concat(subclass, ' ', substr(code_norm, 5)) else code_norm end) like '%b02 d%'),
above as (select code_norm from hit union select unnest([substr(code_norm, 1, 1), substr(code_norm, 1, 3), substr(code_norm, 1, 4), concat(split_part(code_norm, '/', 1), '/00')]) from hit),
picked as (select 'top' as "of", code_norm, false as is_match from node where code_norm ~ '^[A-H]$' union all select 'A', code_norm, false from node where level = 1 and code_norm like 'A%' union all select 'h09', code_norm, false from node where level = 2 and code_norm like 'H09%'
union all select 'H09J', code_norm, false from node where level = 3 and code_norm like 'H09J%' union all select 'E09D 15/00', code_norm, false from node where level = 4 and grp = 'E09D15' union all select 'search', n.code_norm, n.code_norm in (select code_norm from hit) from node n where n.code_norm in (select code_norm from above))
select "of", code_norm, parent, depth, has_children, is_match from picked join node using (code_norm) union all select 'total', cast(count(*) as varchar), null, null, null, null from hit""",
    "backfill": "select l.doc_id, coalesce(case when quality = 1 then 'xx' end, d.lang) as lang from labels l left join documents d on l.doc_id = d.doc_id",
    "kv_list": f"with {CODED_SQL} select code_norm, case level when 0 then 'section' when 1 then 'class' when 2 then 'subclass' when 3 then 'main_group' else 'subgroup' end as label from dictionary where code_norm like 'A%' order by 1 = 1, case when length(code_norm) > 2 then substr(code_norm, 1, 3) end nulls last, case when length(code_norm) > 3 then substr(code_norm, 1, 4) end nulls last, try_cast(case when code_norm like '%/%' then substr(split_part(code_norm, '/', 1), 5) end as int) nulls last, case when code_norm like '%/%' then split_part(code_norm, '/', 2) end nulls last, code_norm limit 40",
    "child_rows": "select conv_id, role, min(turn) as turn from conversations group by conv_id, role",
}
