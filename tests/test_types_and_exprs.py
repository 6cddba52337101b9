import math
import random

import pytest

from quern.functions import scalar
from quern.plans import expr as X
from quern.plans import parser as P
from quern.types import EngineError, Type

I, R, V, D, B = Type.INTEGER, Type.FLOAT, Type.VARCHAR, Type.DATETIME, Type.BOOLEAN
IMPLICIT = {(I, R), (B, I), (B, R), (V, D), (D, V)} | {(t, t) for t in Type}


@pytest.mark.parametrize("a", list(Type))
@pytest.mark.parametrize("b", list(Type))
def test_cast_matrix(a, b):
    assert a.implicit(b) == ((a, b) in IMPLICIT)
    assert a.explicit(b) == ((a, b) in IMPLICIT or b is V or (a, b) == (R, I))


def test_comparison_prefers_the_left_type():
    ts, text = X.Expr("col", D, value=("t", "g")), X.literal("2000-01-02")
    assert X.call(">", (ts, text)).args[1].type is D
    assert X.call("<", (text, ts)).args[1].type is V
    with pytest.raises(EngineError):
        X.call("=", (X.literal(1), X.literal("1")))


@pytest.mark.parametrize("sql", ["1 || 'a'", "1.5 % 2", "NOT 1", "'a' + 1", "LOWER(1)", "REPLACE('a', 'b')", "SUM(SUM(1))", "CAST('1' AS INT)", "CAST(1 AS DATETIME)", "CAST(1 AS TEXT)", "COUNT(DISTINCT 1, 2)", "SUM('a')", "SUM(TRUE)"])
def test_rejected_expressions(sql):
    from quern.plans.analyzer import Scope

    with pytest.raises(EngineError):
        Scope([]).typed(P.parse(f"SELECT {sql} FROM t")[0].items[0][0])


@pytest.mark.parametrize("sql", ["SELECT 1", "SELECT a FROM t JOIN s ON a = b", "SELECT a FROM (SELECT 1 FROM t)", "UPDATE t SET a = 1", "DROP TABLE t", "SELECT a FROM t UNION SELECT a FROM t", "CREATE TABLE t(a INT PRIMARY KEY)", "CREATE TABLE t(a VARCHAR(3))", "INSERT INTO t(a) VALUES (1)", "SELECT CASE WHEN a THEN 1 END FROM t", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a IS NULL", "SELECT NULL FROM t", "SELECT SUM(a) OVER () FROM t", "SELECT 'a FROM t", "WITH x AS (SELECT a FROM t) SELECT a FROM x"])
def test_rejected_statements(sql):
    with pytest.raises(EngineError):
        P.parse(sql)


def test_precedence():
    e = P.parse("SELECT NOT a = 1 AND b OR -c * 2 + 1 < 3 FROM t")[0].items[0][0]
    assert e.op == "or" and e.args[0].op == "and" and e.args[0].args[0].op == "not" and e.args[1].op == "<"
    assert P.parse("SELECT a - b - c FROM t -- end\n;")[0].items[0][0].args[0].op == "-"


def test_division_and_modulo_follow_python(spark):
    rng = random.Random(1)
    rows = [(a, b) for a in (-7, -1, 0, 1, 7, 2**40) for b in (-3, -2, 2, 3)] + [(rng.randint(-999, 999), rng.choice([-17, -5, 5, 17])) for _ in range(100)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", scalar.floor_divide(df.a, df.b), scalar.modulo(df.a, df.b)).collect()
    assert all((q, m) == (a // b, a % b) for a, b, q, m in got)


def test_texts_of_floats_follow_python(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-4, 1.5e-5, 1e15, 1e16, 1e20, -1e300, 5e-324, 123456.789, 1e-10, 9007199254740993.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 22) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for x, s in df.select("x", scalar.float_text(df.x)).collect():
        assert s == repr(x) or math.isclose(float(s), x, rel_tol=1e-15), (x, s)
