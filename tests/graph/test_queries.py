import os

import duckdb
import pytest

import __spark_entry__ as entry
from kgspark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["n1", "n2"] and rows.count() > 0


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_representative_is_registered_whole(spark):
    rows = queries.QUERIES["D7_representative_whole"](spark, SF)
    assert {r.prefix for r in rows.selectExpr("split_part(subject, ':', 1) AS prefix").distinct().collect()} > {"NATION", "ORDER", "PART", "SUPP"}


def test_rendered_edges_of_more_customers_than_a_message_holds(spark, tmp_path):
    """10,500 customers of one nation: every one of them is shown."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        many = "SELECT * REPLACE (c_custkey + 1000 * k AS c_custkey) FROM t, range(3500) r(k)" if f == "customer.parquet" else "FROM t"
        con.execute(f"COPY (WITH t AS (FROM '{SF}/{f}') {many}) TO '{tmp_path}/{f}'")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{tmp_path}/{f}'")
    want = con.execute(queries.ORACLE_SQL["T13_rendered"]).fetchall()
    assert len(want) == 10_500
    assert sorted(map(tuple, queries.QUERIES["T13_rendered"](spark, str(tmp_path)).select("subject", "attributes").collect())) == sorted(want)
