"""Queries held against their SQL, or steps of them, on what only large tables have."""

import duckdb

from __spark_entry__ import oracle_sql, queries

PARTS = "select {key}::bigint as p_partkey, 'blue plate' as p_name, 'Brand#11' as p_brand, 'LARGE' as p_type, (i % 50 + 1)::int as p_size from range({n}) t(i)"


def differences(spark, name, folder, **tables):
    """Rows that only the query has, and those that only its SQL has, on tables made by SQL."""
    db = duckdb.connect()
    for table, sql in tables.items():
        db.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        db.execute(f"create view {table} as from '{folder}/{table}.parquet'")
    found = queries()[name](spark, str(folder))
    found.write.parquet(f"{folder}/found")
    db.execute(f"create table a as from '{folder}/found/*.parquet'; create table b as {oracle_sql()[name]}")
    return [db.execute(f"select * from (from {x} except all from {y}) limit 3").fetchall() for x, y in ("ab", "ba")]


def test_pictures_wider_than_a_frame_can_say(spark, tmp_path):
    assert differences(spark, "jpeg_sizes", tmp_path, part=PARTS.format(key="65000 + i * 7", n=300)) == [[], []]


def test_transfers_of_over_a_megabyte(spark, tmp_path):
    assert differences(spark, "size_text", tmp_path, part=PARTS.format(key="1048000 + i * 7", n=300)) == [[], []]


def test_disclosures_find_marks_once_a_row(spark, tmp_path):
    assert differences(spark, "disclosure", tmp_path, part=PARTS.format(key="i", n=210)) == [[], []]
    plan = queries()["disclosure"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # three results at most name the marks, and rows are dealt out before
    assert plan.count("rlike") + plan.count("RLIKE") <= 9 and "RepartitionByExpression" in plan


def test_codes_are_parsed_once_they_are_distinct(spark, tmp_path):
    orders = "select i::bigint as o_orderkey, i::bigint as o_custkey, ['1-URGENT', '5-LOW'][i % 2 + 1] as o_orderpriority, timestamp '2020-01-01' as o_orderdate from range(5000) t(i)"
    assert differences(spark, "class_tree_children", tmp_path, orders=orders) == [[], []]
    plan = queries()["class_tree_children"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    below = [part.rpartition("Aggregate")[2].partition("\n")[2] for part in plan.split("Relation")[:-1]]  # between each table and the first aggregate
    assert below and all("regexp" not in part and "rlike" not in part.lower() for part in below) and "regexp" in plan


def test_pictures_are_dealt_out_to_all_tasks(spark, tmp_path):
    assert differences(spark, "image_likeness", tmp_path, part=PARTS.format(key="i", n=100)) == [[], []]
    assert spark.read.parquet(f"{tmp_path}/found").selectExpr("input_file_name() as f").distinct().count() == 4


def test_pictures_are_made_by_all_tasks_and_met_once(spark, tmp_path):
    duckdb.execute(f"copy ({PARTS.format(key='i', n=40)}) to '{tmp_path}/part.parquet' (format parquet)")
    found = queries()["image_matches"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # once for the matches and once for what is shown, each time by rows that are dealt out
    assert plan.count("MapInPandas") == plan.count("RepartitionByExpression") == 2 and plan.count("MapInArrow") == 1
    figures = found.where("file_name = 'figure.TIF'").collect()
    assert len(figures) == 40 and all((r.canonical_file_name == "same.TIF") == (r.patent % 5 == 0) for r in figures)


def parsed_once(spark, name, folder):
    """Whether a query makes the trees of a row once, and nothing of its texts before rows are dealt out."""
    plan = queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    below = plan.rpartition("RepartitionByExpression")[2]
    return plan.count("from_xml(") == 2 and "Relation" in below and "regexp" not in below


def test_parties_are_parsed_once_a_row_by_all_tasks(spark, tmp_path):
    assert differences(spark, "xml_parties", tmp_path, part=PARTS.format(key="i * 7", n=120)) == [[], []]
    assert parsed_once(spark, "xml_parties", tmp_path)


def test_documents_are_parsed_once_a_row_by_all_tasks(spark, tmp_path):
    assert differences(spark, "xml_parse", tmp_path, part=PARTS.format(key="i * 7", n=120)) == [[], []]
    assert parsed_once(spark, "xml_parse", tmp_path)
