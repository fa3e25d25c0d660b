"""Every registered query beside its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import plan_of
from check import TABLES, compare, rows_of

import __spark_entry__ as entry
from strataspark.suite import ORACLE, QUERIES



@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    plan = plan_of(df)
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = sql.execute(ORACLE[name])
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert names == want_names
    assert compare(got, want) in ("exact", "near")
    assert got


def test_entry_has_them_all():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["age_group"] for r in rows} >= {"Total"}
    assert sum(r["n"] for r in rows if r["age_group"] != "Total") == 134
