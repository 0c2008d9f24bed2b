"""Every query with SQL gives the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from vellum.plans import batch_ops, codes, records, search, stored, tables_ops, written

FOLDER = "/root/testdata/sf0.01"
MODULES = (search, codes, tables_ops, batch_ops, records, stored, written)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return "nan" if math.isnan(value) else round(float(value), 5) + 0.0
    return value


@pytest.mark.parametrize("module, name", NAMES, ids=[n for _, n in NAMES])
def test_same_rows(spark, duck, module, name):
    df = module.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours
    if name not in module.ORACLE_SQL:
        return
    found = duck.execute(module.ORACLE_SQL[name])
    theirs_columns = [d[0] for d in found.description]
    assert sorted(theirs_columns) == columns
    theirs = sorted((tuple(plain(r[theirs_columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
