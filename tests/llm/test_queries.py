import duckdb
import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted([*(f"op{k}" for k in range(1, 11)), "pipeline"])


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*columns).collect())) == sorted(want)
