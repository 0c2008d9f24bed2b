"""Queries over what is stored first: archives, versions of tables, and indexes of vectors and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import conditions as C
from vellum.operators import checkpoints, commits, text_index, vector_index
from vellum.plans import batch_ops
from vellum.plans.batch_ops import batch_changes
from vellum.plans.tables import table
from vellum.shared import new_folder
from vellum.sources import archives
from vellum.sources.stores import put
from vellum.streaming import states


def archive_entries(spark, sf_dir):
    """Orders packed into archives in three parts each, read back by ranges: entries, bytes and sums of keys of each archive."""
    folder = new_folder(spark, "archives")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<o>"), "o_orderkey", F.lit(" "), "o_orderpriority", F.lit("</o>")).alias("content"))

    def packed(rows):
        import io
        import zipfile

        import pandas as pd

        name, out = f"b{rows['o_orderkey'].iloc[0] // 20_000}", io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for key, content in zip(rows["o_orderkey"], rows["content"]):
                z.writestr(f"o/{key}.xml", content)
                if key % 10 == 0:
                    z.writestr(f"o/{key}.txt", "not wanted")
        data = out.getvalue()
        cut = len(data) // 3
        for ending, part in ((".z01", data[:cut]), (".z02", data[cut : 2 * cut]), (".zip", data[2 * cut :])):
            put(f"{folder}/{name}{ending}", part)
        return pd.DataFrame({"name": [name]})

    orders.groupBy(F.expr("o_orderkey div 20000")).applyInPandas(packed, "name string").count()
    rows = archives.entries(spark, folder)
    key = F.regexp_extract("entry_name", r"(\d+)\.xml\z", 1).cast("long")
    return rows.groupBy("zip_name").agg(F.count_if(F.col("error").isNull()).alias("entries"), F.sum(F.length("content")).alias("bytes"), F.sum(key).alias("keys"))


def table_versions(spark, sf_dir):
    """Rows of each table in each version: patents with claims are stored, then some merged in with their claims, then a batch is deleted."""
    root = new_folder(spark, "tables")
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    patents = lambda mark: orders.select(F.concat(F.lit(mark), key).alias("id"), key.cast("string").alias("doc_number"), "o_orderstatus", F.col("o_orderpriority").alias("batch_id"))
    claims = lambda mark: items.select(F.concat(F.lit(mark), "l_orderkey").alias("patent_id"), F.col("l_linenumber").alias("claim_num"), "l_orderkey")
    first, later = F.col("doc_number") % 3 > 0, F.col("doc_number") % 3 < 2
    commits.upsert_patents(spark, root, patents("p").where(first), {"patent_claim": claims("p").where("l_orderkey % 3 > 0").drop("l_orderkey")}, ["doc_number"], ["batch_id"])
    new = patents("q").where(later).withColumn("batch_id", F.when(F.col("doc_number") % 2 == 0, "9-NEW").otherwise(F.col("batch_id")))
    commits.upsert_patents(spark, root, new, {"patent_claim": claims("q").where("l_orderkey % 3 < 2 and claim_num < 3").drop("l_orderkey")}, ["doc_number"], ["batch_id"])
    commits.delete_batch(spark, root, "9-NEW")
    out = []
    for version in commits.versions(spark, root):
        now = commits.snapshot(spark, root, version)
        out += [now.table(name).agg(F.lit(version).alias("version"), F.lit(name).alias("name"), F.count("*").alias("rows"), F.count_if(F.col(column).startswith("p")).alias("first_ids")) for name, column in (("patent", "id"), ("patent_claim", "patent_id"))]
    return reduce(DataFrame.union, out)


def indexed_vectors(spark, sf_dir):
    """For some vectors the five most alike of all, through the index; exact."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vector_index.build(vectors, new_folder(spark, "vectors"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = vector_index.search_all(index, asked, 5)
    return found.select("query", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


#: Values that texts are searched for through the index, and what else must hold.
_ASKED = {"license": "%license%", "a rare one": "%copyright (c)%", "wildcards": "%e__ii%", "short": "%zq%"}


def indexed_search(spark, sf_dir):
    """Documents that have a value in their text, through the index of trigrams; and those of two values, of which the second is in the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = text_index.build(docs, new_folder(spark, "texts"), ["text", "source"], "doc_id")
    like = lambda column, pattern: F.ilike(F.col(column), F.lit(pattern), F.lit("\\"))
    out = [text_index.find(index, like("text", p), [[("text", p)]]).select(F.lit(name).alias("asked"), "doc_id") for name, p in _ASKED.items()]
    either = C.contains(F.col("text"), "Copyright") & C.contains(F.col("source"), "src1") | C.contains(F.col("source"), "src19")
    needs = [[("text", "%copyright%"), ("source", "%src1%")], [("source", "%src19%")]]
    return reduce(DataFrame.union, [*out, text_index.find(index, either, needs).select(F.lit("either").alias("asked"), "doc_id")])


def state_stream(spark, sf_dir):
    """The state of each user's last change, from a stream of files in another order than that of the changes."""
    changes = batch_changes(spark, sf_dir).select("user_id", "status", "ts", "event_id")
    folder = new_folder(spark, "changes")
    changes.repartition(6, F.xxhash64("event_id")).write.parquet(folder)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    out, partitions = new_folder(spark, "states"), spark.conf.get("spark.sql.shuffle.partitions")
    # each partition of a stream keeps a store of its own, so there are as many as tasks run at once
    spark.conf.set("spark.sql.shuffle.partitions", min(int(partitions), spark.sparkContext.defaultParallelism))
    try:
        states.kept(states.states(stream, "user_id", "status", "ts", "event_id"), out, new_folder(spark, "stream")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = states.last_updates(spark.read.parquet(out), "user_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("user_id", "status", day("started_at").alias("started_at"), day("completed_at").alias("completed_at"))


def resumed_archives(spark, sf_dir):
    """Customers as records of their nations' archives: some are processed, then some of these change, and the rest follows; records and sizes of each archive."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    archives = lambda size: nations.select(F.col("n_name").alias("name"), size.alias("size"), F.lit(1).alias("modified"))
    named = customers.join(nations.select("n_nationkey", F.col("n_name").alias("name")), F.col("c_nationkey") == F.col("n_nationkey"))
    parse = lambda cut: lambda rows: named.join(rows, "name").where(cut).select("name", "size", "c_custkey")
    root, key = new_folder(spark, "processed"), F.col("n_nationkey")
    checkpoints.process(archives(F.lit(1)).where("name < 'J'"), parse(F.col("c_custkey") % 2 == 0), root)
    now = archives(F.when(key % 3 == 0, 2).otherwise(1))
    found = checkpoints.process(now, parse(F.lit(True)), root)
    return found.groupBy("name").agg(F.count("*").alias("records"), F.max("size").alias("size"), F.sum("c_custkey").alias("keys"))


QUERIES = {f.__name__: f for f in (archive_entries, table_versions, indexed_vectors, indexed_search, state_stream, resumed_archives)}

_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))"

ORACLE_SQL = {
    "state_stream": batch_ops.ORACLE_SQL["batch_states"],
    "resumed_archives": """select n_name as name, count(*) as records, case when n_nationkey % 3 = 0 then 2 else 1 end as size, sum(c_custkey)::bigint as keys
from nation join customer on c_nationkey = n_nationkey where c_custkey % 2 = 0 or not (n_name < 'J') or n_nationkey % 3 = 0 group by n_name, n_nationkey""",
    "archive_entries": "select concat('b', o_orderkey // 20000, '.zip') as zip_name, count(*) as entries, sum(length(concat('<o>', o_orderkey, ' ', o_orderpriority, '</o>')))::bigint as bytes, sum(o_orderkey)::bigint as keys from orders group by 1",
    "table_versions": """with p as (select o_orderkey as k, o_orderpriority as b, o_orderkey % 3 > 0 as first, o_orderkey % 3 < 2 as later, o_orderkey % 2 = 0 and o_orderkey % 3 < 2 as gone from orders),
c as (select p.*, l_linenumber as n from p join lineitem on l_orderkey = k)
select 1 as version, 'patent' as name, count(*) as "rows", count(*) as first_ids from p where first union all select 1, 'patent_claim', count(*), count(*) from c where first
union all select 2, 'patent', count(*), count(*) filter (first) from p union all select 2, 'patent_claim', count(*), count(*) filter (first) from c where not later or n < 3
union all select 3, 'patent', count(*), count(*) filter (first) from p where not gone union all select 3, 'patent_claim', count(*), count(*) filter (first) from c where not gone and (not later or n < 3)""",
    "indexed_vectors": f"with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), r as (select a.vec_id as query, b.vec_id, {_COS} as similarity from e a, e b where a.vec_id % 50 = 0) select query, vec_id, cast(row_number() over (partition by query order by similarity desc, vec_id) as int) as rank, round(similarity, 6) as similarity from r qualify rank <= 5",
    "indexed_search": " union all ".join(f"select '{name}' as asked, doc_id from documents where text ilike '{p}'" for name, p in _ASKED.items()) + " union all select 'either', doc_id from documents where (text ilike '%copyright%' and source ilike '%src1%') or source ilike '%src19%'",
}
