"""The queries of text operators that SQL can express give the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from vellum.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    ours = queries.QUERIES[name](spark, FOLDER)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(*columns).collect())) == sorted(found.fetchall())
