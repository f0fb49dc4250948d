"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from streamtable.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return bytes(v) if isinstance(v, bytearray) else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(columns).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    want = tables.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    want = sorted((tuple(plain(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=repr)
    assert rows == want


def test_the_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["word", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_combine_early(spark):
    scan = QUERIES["scan_pushdown"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in scan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in scan
    count = QUERIES["combine_per_key_sum"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in count and count.count("Exchange") == 1
