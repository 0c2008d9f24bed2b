"""Queries of writes by key, logs, reports, folders, and of pictures' and texts' own features."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import image_features as IF
from vellum.operators import integrity as I
from vellum.operators import vectors as V
from vellum.operators import writes as W
from vellum.plans.tables import table
from vellum.shared import new_folder
from vellum.sources import listing
from vellum.sources.stores import put

#: Columns of a picture that one JPEG file of it can have the number of.
STRIPE = 1 << 16


def upserted_dictionary(spark, sf_dir):
    """Entries of a dictionary, some of them old, with new ones merged in by code."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    entry = lambda title, level: (k.cast("string").alias("code_norm"), title.alias("title_en"), level.alias("level"), F.lit("c").alias("created_at"))
    old = p.where(k % 3 > 0).select(*entry(F.lit("old"), F.lit(1)))
    new = p.where(k % 2 == 0).select(*entry(F.when(k % 4 > 0, F.col("p_name")), F.col("p_size"))).withColumn("created_at", F.lit("d"))
    return W.upserted_entries(old, new)


def upserted_vectors(spark, sf_dir):
    """Embeddings with new ones merged in by type, code, version, locale and model."""
    v, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    row = lambda mark, sign: (F.when(k % 5 > 0, "ipc").otherwise("cpc").alias("type"), k.cast("string").alias("code_norm"), F.lit("1").alias("version"), F.when(k % 7 > 0, "en").alias("locale"), F.lit("m").alias("embedding_model"), F.lit(mark).alias("content_hash"), F.transform("embedding", lambda x: x.cast("double") * sign).alias("embedding"))
    found = W.upserted_embeddings(v.where(k % 3 > 0).select(*row("old", 1)), v.where(k % 2 == 0).select(*row("new", -1)))
    return found.select("type", "code_norm", "locale", "content_hash", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), "is_new")


def appended_log(spark, sf_dir):
    """Entries added to a log in two writes, each in today's wording."""
    path, events = new_folder(spark, "log"), table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "click", "Start processing step").when(F.col("event_id") % 2 == 0, F.concat(F.lit("Extract outer archive package: "), "user_id", F.lit(" file(s)"))).otherwise(F.col("event_type"))
    for part in (0, 1):
        W.append_log(events.where(F.col("event_id") % 3 == part).select("event_id", said.alias("message")), path)
    return spark.read.parquet(path).groupBy("message").agg(F.count("*").alias("entries"), F.min("event_id").alias("first"))


def failure_report(spark, sf_dir):
    """A line for each failure of a check."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    reason = F.element_at(F.array(*map(F.lit, (*I.REASONS, "another"))), (k % (len(I.REASONS) + 1) + 1).cast("int"))
    return I.report(c.select(F.col("c_name").alias("file"), reason.alias("reason"), F.when(k % 3 > 0, F.hex(k)).alias("expected"), F.when(k % 2 > 0, F.hex(k + 1)).alias("actual")))


def jpeg_sizes(spark, sf_dir):
    """Width and height of pictures of which two in three are JPEG.

    A frame has 16 bits for its width. So a picture is two files: one is as wide as there are whole stripes of 65,536 columns, the other as what is left.
    """
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    four = lambda c: F.lpad(F.hex(c), 4, "0")
    jpeg = lambda width: F.concat(F.lit("FFD8FFE000046162FFC0000B08"), four(F.col("p_size")), four(width), F.lit("01011100FFD9"))
    size = lambda width: IF.jpeg_size(F.unhex(F.when(k % 3 > 0, jpeg(width)).otherwise(F.lit("89504E47"))))
    sizes = p.select("p_partkey", size(F.floor(k / STRIPE)).alias("stripes"), size(k % STRIPE).alias("last"))
    return sizes.select("p_partkey", (F.col("stripes.width") * STRIPE + F.col("last.width")).alias("width"), "last.height")


def text_search(spark, sf_dir):
    """Entries whose vector, made from their text by numbers of letters, is most alike that of a search text."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code_norm"), F.lit("1").alias("version"), F.lit("A").alias("section"), F.lower("p_name").alias("title_en"))

    def embed(texts):
        return [[t.count("e"), t.count("a"), t.count("o"), 1] for t in texts]

    embeddings = V.embedded(p, "title_en", embed, 4).select("code_norm", "version", "embedding")
    return V.search_by_text(embeddings, p, "  goes area ", embed, 15).select("code_norm", "title_en", F.round("similarity", 6).alias("similarity"), "percent")


def walked_folder(spark, sf_dir):
    """A folder of regions and nations with a file for each customer of some, walked by level; directories that a pattern is found in; and those two levels below, the last name first."""
    root = new_folder(spark, "walked")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 = 1").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "c_name", F.lit(".ZIP")).alias("name"), (F.col("c_custkey") % 40).alias("size"))

    def written(source):
        for batch in source:
            for name, size in zip(batch["name"], batch["size"]):
                put(f"{root}/{name}", b"x" * size)
            yield batch

    rows.mapInPandas(written, "name string, size long").count()
    found = listing.walk(spark, root)
    below = lambda df, name: df.select(F.lit(name).alias("of"), F.expr(f"substr(path, {len(root) + 2})").alias("path"), "type", "size")
    return below(found, "walk").union(below(listing.folders_like(found, "IA$"), "like")).union(below(listing.data_folders(found, root), "data"))


QUERIES = {f.__name__: f for f in (upserted_dictionary, upserted_vectors, appended_log, failure_report, jpeg_sizes, text_search, walked_folder)}

_REASON = " ".join(f"when {i} then '{said}'" for i, said in enumerate(I.REASONS.values()))
_FILES = "f as (select r_name as r, n_name as n, concat(r_name, '/', n_name, '/', c_name, '.ZIP') as path, c_custkey % 40 as size from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 10 = 1)"

ORACLE_SQL = {
    "upserted_dictionary": "select cast(p_partkey as varchar) as code_norm, case when p_partkey % 2 = 0 then case when p_partkey % 4 > 0 then p_name end else 'old' end as title_en, cast(case when p_partkey % 2 = 0 then p_size else 1 end as int) as level, case when p_partkey % 3 > 0 then 'c' else 'd' end as created_at, p_partkey % 3 = 0 as is_new from part where p_partkey % 3 > 0 or p_partkey % 2 = 0",
    "upserted_vectors": "select case when vec_id % 5 > 0 then 'ipc' else 'cpc' end as type, cast(vec_id as varchar) as code_norm, case when vec_id % 7 > 0 then 'en' end as locale, case when vec_id % 2 = 0 then 'new' else 'old' end as content_hash, round(cast(embedding[1] as double) * case when vec_id % 2 = 0 then -1 else 1 end, 6) as first, vec_id % 3 = 0 as is_new from embeddings where vec_id % 3 > 0 or vec_id % 2 = 0",
    "appended_log": "select case when event_type = 'click' then '开始处理步骤' when event_id % 2 = 0 then concat('解压外层压缩包：', user_id, ' 个文件') else event_type end as message, count(*) as entries, min(event_id) as first from events where event_id % 3 < 2 group by 1",
    "failure_report": f"select concat('  - ', c_name, ': ', case c_custkey % {len(I.REASONS) + 1} {_REASON} else 'another' end, case when c_custkey % 3 > 0 and c_custkey % 2 > 0 then concat(' (期望: ', printf('%X', c_custkey), ', 实际: ', printf('%X', c_custkey + 1), ')') else '' end) as line from customer",
    "jpeg_sizes": "select p_partkey, cast(case when p_partkey % 3 > 0 then p_partkey end as int) as width, cast(case when p_partkey % 3 > 0 then p_size end as int) as height from part",
    "text_search": """with p as (select p_partkey as code_norm, lower(p_name) as title_en from part), e as (select *, length(title_en) - length(replace(title_en, 'e', '')) as e, length(title_en) - length(replace(title_en, 'a', '')) as a, length(title_en) - length(replace(title_en, 'o', '')) as o from p),
s as (select code_norm, title_en, cast(2 * e + 2 * a + o + 1 as double) / (sqrt(cast(e * e + a * a + o * o + 1 as double)) * sqrt(10.0::double)) as similarity from e)
select code_norm, title_en, round(similarity, 6) as similarity, printf('%.1f%%', similarity * 100) as percent from s order by s.similarity desc, code_norm limit 15""",
    "walked_folder": f"""with {_FILES}, d as (select distinct r as path, r as name, 1 as level from f union all select distinct concat(r, '/', n), n, 2 from f)
select 'walk' as "of", path, 'file' as type, size from f union all select 'walk', path, 'directory', 0 from d union all select 'like', path, 'directory', 0 from d where name like '%IA' union all select 'data', path, 'directory', 0 from d where level = 2""",
}
