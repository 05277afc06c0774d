import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from kgspark.llm import queries

TESTDATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE_SQL])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{TESTDATA}/documents.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, TESTDATA).toPandas()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, got[order].astype(str).values)) == sorted(map(tuple, want[order].astype(str).values))


def test_registered(spark):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    n = pq.read_metadata(f"{TESTDATA}/documents.parquet").num_rows
    for name in ("op2_knn_quality", "op4_subword_toxicity", "op7_surrogates", "op8_bpe", "op9_jaccard"):
        rows = names[name](spark, TESTDATA)
        assert rows.count() == n == rows.select("doc_id").distinct().count(), name
