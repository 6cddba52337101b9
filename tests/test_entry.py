import duckdb
import pytest

import __spark_entry__ as entry
from quern import queries as engine

SF = "/root/testdata/sf0.001"
CHOSEN = ["int_floor_div", "cast_ts_varchar", "str_vs_ts_left", "equi_residual", "five_way", "stddev_pop_distinct", "compound_agg", "empty_global_agg", "insert_select", "delete_where"]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in engine.TABLES[:7]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(engine.ORACLE[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = engine.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
