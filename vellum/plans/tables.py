"""The driver's tables read as the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out to the tasks that run at once: a table of few bytes is read by one, however much is made of its rows."""
    spark = rows.sparkSession
    # a given number, as small rows would be put together in one task again
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as patents: the first line is the title, the whole the abstract."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("kind"), F.col("source").alias("batch_id"))


#: A code for each order, of every level and both ways of writing, as SQL that Spark and DuckDB share.
RAW_CODE = """case o_orderkey % 5
 when 0 then substr('ABCDEFGH', cast(o_orderkey % 8 + 1 as int), 1)
 when 1 then concat(substr('ABCDEFGH', cast(o_orderkey % 8 + 1 as int), 1), lpad(cast(o_orderkey % 9 + 1 as {text}), 2, '0'))
 when 2 then concat(substr('abcdefgh', cast(o_orderkey % 8 + 1 as int), 1), lpad(cast(o_orderkey % 9 + 1 as {text}), 2, '0'), substr('BCDFGHJK', cast(o_orderkey % 7 + 1 as int), 1))
 when 3 then concat(substr('ABCDEFGH', cast(o_orderkey % 8 + 1 as int), 1), lpad(cast(o_orderkey % 9 + 1 as {text}), 2, '0'), substr('BCDFGHJK', cast(o_orderkey % 7 + 1 as int), 1), ' ', cast(o_orderkey % 30 + 1 as {text}), '/', lpad(cast(o_orderkey % 4 * 2 as {text}), 2, '0'), ' (2006.01)')
 else concat(substr('ABCDEFGH', cast(o_orderkey % 8 + 1 as int), 1), lpad(cast(o_orderkey % 9 + 1 as {text}), 2, '0'), substr('BCDFGHJK', cast(o_orderkey % 7 + 1 as int), 1), lpad(cast(o_orderkey % 30 + 1 as {text}), 4, '0'), rpad(lpad(cast(o_orderkey % 4 * 2 as {text}), 2, '0'), 6, '0'))
end"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with a raw classification code."""
    return table(spark, sf_dir, "orders").withColumn("raw_code", F.expr(RAW_CODE.format(text="string")))


#: The same in DuckDB, normalized by its own means.
CODED_SQL = f"""raw as (select o_orderkey, o_custkey, o_orderpriority, o_orderdate, {RAW_CODE.format(text="varchar")} as raw_code from orders),
short as (select *, upper(replace(regexp_replace(raw_code, '\\s*\\([0-9]{{4}}\\.[0-9]{{2}}\\)\\s*', '', 'g'), ' ', '')) as bare from raw),
coded as (select *, case when regexp_full_match(bare, '[A-H][0-9]{{2}}[A-Z][0-9]{{10}}')
  then concat(substr(bare, 1, 4), cast(cast(substr(bare, 5, 4) as int) as varchar), '/', case when length(rtrim(substr(bare, 9, 6), '0')) < 2 then rpad(rtrim(substr(bare, 9, 6), '0'), 2, '0') else rtrim(substr(bare, 9, 6), '0') end)
  else bare end as code_norm from short),
leveled as (select *, case when regexp_full_match(code_norm, '[A-Z][0-9]{{2}}') then 1 when regexp_full_match(code_norm, '[A-Z][0-9]{{2}}[A-Z]') then 2
  when code_norm like '%/00' then 3 when code_norm like '%/%' then 4 else 0 end as level from coded),
dictionary as (select code_norm, level, min(o_orderpriority) as title_en from leveled group by code_norm, level)"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each code of ``coded``."""
    from vellum.functions.codes import normalized
    from vellum.operators.classification import entries

    # raw codes are made distinct first, so that each is parsed once; as a maximum a code is known behind the aggregate only, so filters on it stay there
    pairs = coded(spark, sf_dir).select("raw_code", "o_orderpriority").distinct()
    raw = pairs.groupBy("raw_code").agg(F.max("raw_code").alias("code"), F.min("o_orderpriority").alias("title_en"))
    norm = raw.groupBy(normalized(F.col("code")).alias("code_norm")).agg(F.min("title_en").alias("title_en"))
    return entries(norm, None, "title_en")
