"""The registered queries: statements in the engine's SQL over the driver's tables, each with the DuckDB SQL that has the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import Session
from quern.types import Type

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(spark: SparkSession, sf_dir: str, text: str) -> Session:
    """A session with the driver's tables that a script names."""
    out = Session(spark)
    names = set(re.findall(r"\w+", text.lower()))
    for t in TABLES:
        if t in names:
            out.catalog.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return out


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, script: str, oracle: str | None = None, digits: int = 4) -> None:
    """script: statements of which the last is the query. oracle: DuckDB SQL if it differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = session(spark, sf_dir, script).run(script)
        for r in done:
            if r.error:
                raise RuntimeError(f"{name}: {r.error}")
        return rounded(done[-1].df, digits)

    run.__name__ = name
    QUERIES[name] = run
    if oracle != "":
        ORACLE[name] = oracle or script


# scans, filters, projections
add("table_scan", "SELECT r_regionkey, r_name FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
add("scan_star_alias", "SELECT n.* FROM nation n WHERE n.n_regionkey = 2", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey = 2")
add("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem", 6)
add("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_custkey < 100")
add("alias_reference", "SELECT l_orderkey AS k, l_quantity * 2 AS twice, twice + 1 AS more FROM lineitem WHERE twice > 90", "SELECT l_orderkey AS k, l_quantity * 2 AS twice, l_quantity * 2 + 1 AS more FROM lineitem WHERE l_quantity * 2 > 90")
add("index_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderkey = 7")
add("index_range", "SELECT o_orderkey, o_custkey FROM orders WHERE 100 <= o_orderkey AND o_orderkey < 400")
add("secondary_index_fetch", "CREATE INDEX ON orders(o_custkey); SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 10", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 10")
add(
    "literal_table",
    "CREATE TABLE v(a INT, b FLOAT, c VARCHAR, d BOOLEAN, e DATETIME); INSERT INTO v VALUES (1, 2, 'x', TRUE, '2000-01-02'), (2.7, 0.5, 3, FALSE, '2000-01-02 03:04:05'), (-3, 1 + 1, 'it''s', TRUE, '1999-12-31'); SELECT * FROM v",
    "SELECT * FROM (VALUES (1::BIGINT, 2.0::DOUBLE, 'x', TRUE, TIMESTAMP '2000-01-02'), (2, 0.5, '3', FALSE, TIMESTAMP '2000-01-02 03:04:05'), (-3, 2.0, 'it''s', TRUE, TIMESTAMP '1999-12-31')) t(a, b, c, d, e)",
)

# arithmetic
_MOD = "((({a}) % ({b}) + ({b})) % ({b}))"
_m = _MOD.format(a="s_suppkey * 7 - 300", b="s_nationkey - 30")
add("int_mod_sign", "SELECT s_suppkey, (s_suppkey * 7 - 300) % (s_nationkey - 30) AS m FROM supplier", f"SELECT s_suppkey, ({_m})::BIGINT AS m FROM supplier")
add("int_floor_div", "SELECT s_suppkey, (s_suppkey * 7 - 300) / (s_nationkey - 30) AS q FROM supplier", f"SELECT s_suppkey, ((s_suppkey * 7 - 300 - {_m}) // (s_nationkey - 30))::BIGINT AS q FROM supplier")
add("float_div", "SELECT p_partkey, p_retailprice / p_size AS q FROM part", "SELECT p_partkey, round(p_retailprice / p_size, 4) AS q FROM part")
add("neg", "SELECT c_custkey, -c_acctbal AS b, -c_nationkey AS n FROM customer", "SELECT c_custkey, round(-c_acctbal, 4) AS b, (-c_nationkey)::BIGINT AS n FROM customer")
add("guarded_div", "SELECT c_custkey FROM customer WHERE c_nationkey <> 0 AND 100 / c_nationkey > 9", "SELECT c_custkey FROM customer WHERE CASE WHEN c_nationkey <> 0 THEN 100 // c_nationkey > 9 ELSE FALSE END")

# strings and casts
add("concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS s FROM customer")
add("lower_upper", "SELECT p_partkey, LOWER(p_name) AS l, UPPER(p_type) AS u FROM part")
add("replace", "SELECT p_partkey, REPLACE(p_type, 'A', '[a]') AS r FROM part")
add("regexp_match", "SELECT p_partkey, p_type FROM part WHERE p_type ~ '[A-M].*E'", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(?:[A-M].*E)')")
add("cast_float_int", "SELECT c_custkey, CAST(c_acctbal AS INT) AS i, CAST(c_nationkey AS FLOAT) AS f FROM customer", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS i, c_nationkey::DOUBLE AS f FROM customer")
add("cast_ts_varchar", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(o_orderdate) % 1000000 <> 0 THEN strftime(o_orderdate, '.%f') ELSE '' END AS t FROM orders")
add("cast_bool_int", "SELECT s_suppkey, CAST(s_acctbal > 0 AS INT) AS i, CAST(s_acctbal > 0 AS VARCHAR) AS v FROM supplier", "SELECT s_suppkey, (s_acctbal > 0)::BIGINT AS i, CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END AS v FROM supplier")
add("cast_int_varchar", "SELECT n_nationkey, n_name || CAST(n_nationkey AS VARCHAR) AS v FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || n_nationkey::VARCHAR AS v FROM nation")
add("cast_varchar_ts", "SELECT o_orderkey FROM orders WHERE o_orderdate < CAST('1995-03-15' AS DATETIME)", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-15'")

# comparisons
add("cmp_all", "SELECT l_orderkey, l_linenumber, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge FROM lineitem")
add("cmp_bool_int", "SELECT n_nationkey FROM nation WHERE n_regionkey = TRUE", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_regionkey = 1")
add("str_vs_ts_right", "SELECT o_orderkey FROM orders WHERE o_orderdate > '1996-01-02'", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-02'")
add("str_vs_ts_left", "SELECT o_orderkey FROM orders WHERE '1996-01-02' < o_orderdate", "SELECT o_orderkey FROM orders WHERE '1996-01-02' < strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')")

# joins
add("cross_product", "SELECT r_name, n_name FROM region, nation")
add("equi_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
add("equi_merge", "SET INDEX_JOIN OFF; SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
add("equi_hash", "SET INDEX_JOIN OFF; SET SORT_MERGE_JOIN OFF; SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
add("equi_nested_loop", "SET INDEX_JOIN OFF; SET SORT_MERGE_JOIN OFF; SET HASH_JOIN OFF; SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
add("naive_planner", "SET PLANNER NAIVE; SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name > 'B'", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name > 'B'")
add("theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_name < b.n_name", "SELECT a.n_nationkey::BIGINT AS x, b.n_nationkey::BIGINT AS y FROM nation a, nation b WHERE a.n_name < b.n_name")
add("index_nl_range", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_suppkey <= b.s_suppkey AND b.s_suppkey < a.s_suppkey + 3")
add("equi_residual", "SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice > o_totalprice / 2", "SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice > o_totalprice / 2")
add("multi_key", "SELECT a.l_orderkey AS k, a.l_linenumber AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1", "SELECT a.l_orderkey AS k, a.l_linenumber::BIGINT AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
add("cast_key", "SELECT l_orderkey, p_partkey FROM lineitem, part WHERE l_quantity = p_size AND l_partkey = p_partkey")
add("self_join", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a, customer b WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
add("three_way", "SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'")
add(
    "five_way",
    "SELECT n_name, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM region, nation, customer, orders, lineitem WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_orderdate >= '1994-01-01' GROUP BY n_name",
    "SELECT n_name, round(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM region, nation, customer, orders, lineitem WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n_name",
)

# aggregates, plain and distinct
_FLAT = "l_returnflag"
for _f, _out in (("sum", "bigint"), ("count", "bigint"), ("avg", "double"), ("stddev_pop", "double"), ("min", "bigint"), ("max", "bigint")):
    for _d in ("", "DISTINCT "):
        _int = f"{_f}({_d}l_suppkey)"
        add(f"{_f}{'_distinct' if _d else ''}", f"SELECT l_returnflag, {_int} AS i, {_f}({_d}l_discount) AS x FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {f'round({_int}, 4)' if _out == 'double' else f'{_int}::BIGINT'} AS i, {f'{_f}({_d}l_discount)' if _f == 'count' else f'round({_f}({_d}l_discount), 4)'} AS x FROM lineitem GROUP BY l_returnflag")
add("min_max_text_time", "SELECT o_orderstatus, MIN(o_orderpriority) AS a, MAX(o_orderpriority) AS b, MIN(DISTINCT(o_orderdate)) AS c, MAX(o_orderdate) AS d, COUNT(DISTINCT o_orderpriority) AS e FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, MIN(o_orderpriority) AS a, MAX(o_orderpriority) AS b, MIN(o_orderdate) AS c, MAX(o_orderdate) AS d, COUNT(DISTINCT o_orderpriority) AS e FROM orders GROUP BY o_orderstatus")
add("count_star", "SELECT l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_linestatus")
add("group_by_expr", "SELECT o_orderkey % 7 + 1 AS g, o_orderstatus || '_x' AS s, COUNT(1) AS n FROM orders GROUP BY o_orderkey % 7 + 1, o_orderstatus || '_x'", "SELECT (o_orderkey % 7 + 1)::BIGINT AS g, o_orderstatus || '_x' AS s, COUNT(1) AS n FROM orders GROUP BY 1, 2")
add("group_by_constant", "SELECT 1 AS one, COUNT(*) AS n FROM region GROUP BY 1 + 0, 'x'", "SELECT 1::BIGINT AS one, COUNT(*) AS n FROM region")
add("global_agg", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_extendedprice) AS p FROM lineitem WHERE l_discount > 0.05", "SELECT COUNT(*) AS n, round(SUM(l_quantity), 4) AS q, round(AVG(l_extendedprice), 4) AS p FROM lineitem WHERE l_discount > 0.05")
add("having", "SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MIN(o_orderdate) < '1995-01-01'", "SELECT o_custkey, round(SUM(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MIN(o_orderdate) < TIMESTAMP '1995-01-01'", 2)
add("having_without_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1")
add("compound_agg", "SELECT l_returnflag, SUM(l_linenumber + l_suppkey) * 2 AS a, AVG(l_linenumber) - COUNT(DISTINCT l_linestatus) + MAX(l_suppkey) + 3 AS b, MIN(l_linestatus) || '_hello' AS c, (SUM(l_linenumber) + SUM(l_suppkey)) * 2 - 3 AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, (SUM(l_linenumber + l_suppkey) * 2)::BIGINT AS a, round(AVG(l_linenumber) - COUNT(DISTINCT l_linestatus) + MAX(l_suppkey) + 3, 4) AS b, MIN(l_linestatus) || '_hello' AS c, ((SUM(l_linenumber) + SUM(l_suppkey)) * 2 - 3)::BIGINT AS d FROM lineitem GROUP BY l_returnflag")
add("join_group_having", "SELECT c_mktsegment, c_nationkey - n_regionkey AS g, AVG(c_acctbal + n_nationkey) AS m FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY c_mktsegment, c_nationkey - n_regionkey HAVING AVG(c_acctbal + n_nationkey) < 5000.0", "SELECT c_mktsegment, (c_nationkey - n_regionkey)::BIGINT AS g, round(AVG(c_acctbal + n_nationkey), 4) AS m FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY c_mktsegment, c_nationkey - n_regionkey HAVING AVG(c_acctbal + n_nationkey) < 5000.0")
add("empty_global_agg", "SELECT COUNT(*) AS n, SUM(r_regionkey) AS s FROM region WHERE r_regionkey > 100", "SELECT count(*) AS n, SUM(r_regionkey)::BIGINT AS s FROM region WHERE r_regionkey > 100 GROUP BY 'all'")
add("flagship", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, SUM(l_extendedprice) AS p, SUM(l_extendedprice * (1 - l_discount)) AS d, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS c, AVG(l_quantity) AS aq, AVG(l_discount) AS ad, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10", "SELECT l_returnflag, l_linestatus, round(SUM(l_quantity), 2) AS q, round(SUM(l_extendedprice), 2) AS p, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS d, round(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS c, round(AVG(l_quantity), 2) AS aq, round(AVG(l_discount), 2) AS ad, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10", 2)

# extensions: honoured where the fragment itself has no such clause
add("order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 25")
add("dedup_sort", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderstatus", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# changes and transactions
_PORTS = "CREATE TABLE ports(id INT, town VARCHAR, berths INT, PRIMARY KEY(id)); CREATE INDEX ON ports(town); INSERT INTO ports VALUES (40, 'Bergen', 31), (7, 'Cork', 9), (12, 'Porto', 17 + 3); INSERT INTO ports VALUES (23, 'Gdansk', 44); "
add("insert_values", _PORTS + "SELECT * FROM ports", "SELECT * FROM (VALUES (40::BIGINT, 'Bergen', 31::BIGINT), (7, 'Cork', 9), (12, 'Porto', 20), (23, 'Gdansk', 44)) t(id, town, berths)")
add("insert_select", "CREATE TABLE t(k INT, x FLOAT, s VARCHAR); INSERT INTO t (SELECT n_nationkey, n_regionkey, n_name FROM nation); INSERT INTO t (SELECT k + 100, x, s FROM t WHERE x = 1); SELECT * FROM t", "WITH t AS (SELECT n_nationkey::BIGINT AS k, n_regionkey::DOUBLE AS x, n_name AS s FROM nation) SELECT * FROM t UNION ALL SELECT k + 100, x, s FROM t WHERE x = 1")
add("delete_where", "DELETE FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 3; SELECT s_suppkey, s_name FROM supplier", "SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey = 3)")
add("rollback", "SET AUTOCOMMIT OFF; DELETE FROM region; ROLLBACK; SELECT r_name FROM region", "SELECT r_name FROM region")
add("commit", "SET AUTOCOMMIT OFF; DELETE FROM region WHERE r_regionkey = 0; COMMIT; DELETE FROM region; ROLLBACK; SELECT r_name FROM region", "SELECT r_name FROM region WHERE r_regionkey <> 0")


# utilities
def _show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "region nation")
    s.run("CREATE TABLE r(a INT, b VARCHAR, PRIMARY KEY(a)); CREATE INDEX ON r(b)")
    return s.run("SHOW TABLES")[0].df


def _analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column whether its statistics hold: rows exact, distinct values estimated within a fifth of their number and no more than rows."""
    s = session(spark, sf_dir, "orders lineitem")
    s.run("ANALYZE")
    found = []
    for t, x in s.catalog.stats.items():
        df = s.catalog.table(t).df
        exact = df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(F.col(c)).alias(f"d_{c}") for c in x.distinct]).first()
        for c, d in x.distinct.items():
            want = exact[f"d_{c}"] if s.catalog.table(t).types[c] is not Type.DATETIME else exact["rows"]
            found.append((t, c, x.rows, bool(abs(d - want) <= 0.2 * want), bool(1 <= d <= max(1, x.rows))))
    return spark.createDataFrame(found, "table_name string, column_name string, row_count long, near boolean, in_range boolean")


def _analyze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "orders lineitem nation")
    s.run("ANALYZE orders, lineitem, nation")
    return spark.createDataFrame([(t, x.rows) for t, x in s.catalog.stats.items()], "table_name string, row_count long")


QUERIES |= {"show_tables": _show_tables, "analyze_stats": _analyze, "analyze_rows": _analyze_rows}
ORACLE["show_tables"] = "SELECT * FROM (VALUES ('nation', 1::BIGINT, 'n_nationkey', 'INTEGER', ''), ('nation', 2, 'n_name', 'VARCHAR', ''), ('nation', 3, 'n_regionkey', 'INTEGER', ''), ('r', 1, 'a', 'INTEGER', 'pk'), ('r', 2, 'b', 'VARCHAR', 'sk'), ('region', 1, 'r_regionkey', 'INTEGER', ''), ('region', 2, 'r_name', 'VARCHAR', '')) t(table_name, position, column_name, type, role)"
ORACLE["analyze_stats"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, c AS column_name, (SELECT count(*) FROM {t}) AS row_count, TRUE AS near, TRUE AS in_range FROM (SELECT unnest({cols}) AS c)" for t, cols in (("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]), ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])))
ORACLE["analyze_rows"] = "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'nation', count(*) FROM nation"
