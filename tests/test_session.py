import math
import random
import statistics
from datetime import datetime

import pytest

from quern.session import Session
from quern.types import EngineError

PORTS = "CREATE TABLE ports(id INT, town VARCHAR, berths INT, PRIMARY KEY(id)); CREATE INDEX ON ports(town); INSERT INTO ports VALUES (40, 'Bergen', 30), (7, 'Cork', 9), (12, 'Porto', 20), (23, 'Gdansk', 44);"
CALLS = "CREATE TABLE calls(port INT, ship VARCHAR, days FLOAT, crew INT, came DATETIME); CREATE INDEX ON calls(port); INSERT INTO calls VALUES (7, 'Ada', 2.5, 20, '2021-03-04'), (12, 'Ida', 20.0, 7, '2021-05-01'), (40, 'Ada', 9, 20, '2021-06-11'), (40, 'Eos', 9.0, 12, '2021-06-11'), (40, 'Eos', 9.0, 12, '2021-06-11'), (99, 'Ida', 1.5, 7, '2021-07-30');"


def ok(s, text):
    out = s.run(text)
    assert not [r.error for r in out if r.error]
    return out


def rows(s, sql):
    return sorted(map(tuple, ok(s, sql)[-1].df.collect()), key=str)


@pytest.fixture()
def s(spark):
    out = Session(spark)
    ok(out, PORTS + CALLS)
    return out


STRATEGIES = ["", "SET PLANNER NAIVE;", "SET INDEX_JOIN OFF;", "SET INDEX_JOIN OFF; SET SORT_MERGE_JOIN OFF;", "SET INDEX_JOIN OFF; SET SORT_MERGE_JOIN OFF; SET HASH_JOIN OFF;"]


@pytest.mark.parametrize("setting", STRATEGIES)
def test_joins_agree_under_every_strategy(s, setting):
    assert rows(s, setting + "SELECT town, ship FROM ports, calls WHERE id = port") == sorted([("Cork", "Ada"), ("Porto", "Ida"), ("Bergen", "Ada"), ("Bergen", "Eos"), ("Bergen", "Eos")])
    assert rows(s, "SELECT town, ship FROM ports, calls WHERE berths = days") == sorted([("Porto", "Ida"), ("Cork", "Ada"), ("Cork", "Eos"), ("Cork", "Eos")])
    assert len(rows(s, "SELECT * FROM ports, calls")) == 24
    assert len(rows(s, "SELECT x.ship AS a, y.ship AS b FROM calls x, calls y WHERE x.came < y.came")) == 12
    assert rows(s, "SELECT ship, town FROM ports, calls WHERE port <= id AND id < port + 12 AND berths > 10") == sorted([("Ada", "Porto"), ("Ida", "Porto"), ("Ida", "Gdansk"), ("Ada", "Bergen"), ("Eos", "Bergen"), ("Eos", "Bergen")])
    assert rows(s, "SELECT id FROM ports, calls WHERE id = port AND ship = 'Ada' AND 100 / (crew - 7 + id - 12) > 0 AND days > 2.6") == [(40,)]


@pytest.mark.parametrize("seed", range(4))
def test_range_joins_against_all_pairs(spark, seed):
    """Intervals of very different length, empty ones, huge and tiny numbers, and ends that are hit."""
    rng = random.Random(seed)
    number = lambda: rng.choice([rng.randint(-50, 50), rng.uniform(-9, 9), 2.0**60, -(2.0**55), 1e-9, 0.0, rng.randint(-10**6, 10**6)])
    points = [(i, float(number())) for i in range(60)]
    spans = [(i, x, x + rng.choice([0, 1e-6, 0.5, 3, 100, 1e7, 2.0**58, -2])) for i, (_, x) in enumerate(points * 2)]
    s = Session(spark)
    s.catalog.register("p", spark.createDataFrame(points, "i long, x double"))
    s.catalog.register("q", spark.createDataFrame(spans, "j long, a double, b double"))
    for low, high in (("<=", "<"), ("<", "<=")):
        cmp = lambda op, u, v: u <= v if op == "<=" else u < v
        want = sorted(((i, j) for i, x in points for j, a, b in spans if cmp(low, a, x) and cmp(high, x, b)), key=str)
        for frm in ("p, q", "q, p"):
            sql = f"SELECT i, j FROM {frm} WHERE a {low} x AND b {'>' if high == '<' else '>='} x"
            assert rows(s, sql) == want
            plan = s.sql(sql)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hints_reach_the_plan(s):
    for setting, node in zip(STRATEGIES[2:], ("SortMergeJoin", "ShuffledHashJoin", "CartesianProduct"), strict=True):
        plan = ok(s, setting + "SELECT id, ship FROM ports, calls WHERE id = port")[-1].df._jdf.queryExecution().executedPlan().toString()
        assert node in plan


def test_coercion(s):
    assert rows(s, "SELECT id FROM ports WHERE id - 6 = TRUE") == [(7,)]
    assert rows(s, "SELECT ship FROM calls WHERE came > '2021-06-11'") == [("Ida",)]
    assert rows(s, "SELECT ship FROM calls WHERE '2021-06-11' < came AND crew > 7") == [("Ada",), ("Eos",), ("Eos",)]  # as texts the T counts
    assert rows(s, "SELECT CAST(came AS VARCHAR) AS t, CAST(days AS INT) AS i, CAST(days AS VARCHAR) AS v FROM calls WHERE port = 7") == [("2021-03-04T00:00:00", 2, "2.5")]
    assert rows(s, "SELECT -7 / 2 AS q, -7 % 2 AS m, 7 % -2 AS n, 7.0 / 2 AS f FROM ports WHERE id = 7") == [(-4, 1, -1, 3.5)]
    assert rows(s, "SELECT id FROM ports WHERE town ~ '[BG]'") == [(23,), (40,)]
    assert rows(s, "SELECT UPPER(town) || REPLACE(town, 'o', '.') AS x FROM ports WHERE id = 12") == [("PORTOP.rt.",)]


def test_names(s):
    df = ok(s, "SELECT id + 1, town, berths AS x FROM ports")[-1].df
    assert df.columns == ["_col_0", "town", "x"]
    assert rows(s, "SELECT id + 1 AS berths FROM ports WHERE berths > 24") == [(41,)]
    assert rows(s, "SELECT id AS k, k * 2 AS d FROM ports WHERE k > 23") == [(40, 80)]
    for bad in ("SELECT x.id FROM ports x, ports x", "SELECT town FROM ports a, ports b", "SELECT nope FROM ports", "SELECT y.id FROM ports", "SELECT id FROM ports, ports", "SELECT id FROM nowhere", "SELECT z.* FROM ports", "SELECT 1 + DISTINCT id AS x FROM ports"):
        try:
            assert s.run(bad)[0].error, bad
        except EngineError:
            pass


def test_groups(s):
    assert rows(s, "SELECT port, SUM(days) AS t FROM calls GROUP BY port HAVING MIN(DISTINCT(came)) > '2021-03-04'") == [(12, 20.0), (40, 27.0), (99, 1.5)]
    assert rows(s, "SELECT COUNT(*) AS n, COUNT(DISTINCT ship) AS d, SUM(DISTINCT crew) AS s FROM calls") == [(6, 3, 39)]
    assert rows(s, "SELECT COUNT(*) AS n FROM calls WHERE port > 99") == []  # a group needs a row
    assert rows(s, "SELECT COUNT(*) AS n FROM calls HAVING COUNT(*) > 9") == []
    assert rows(s, "SELECT crew % 5 AS g, COUNT(*) AS n FROM calls GROUP BY crew % 5") == [(0, 2), (2, 4)]
    assert rows(s, "SELECT crew % 5 + 1 AS g FROM calls GROUP BY crew % 5 HAVING COUNT(*) - 1 > 1") == [(3,)]
    assert rows(s, "SELECT p.town, SUM(c.days) AS t FROM ports p, calls c WHERE p.id < c.port GROUP BY p.town HAVING SUM(c.days) > 30") == [("Cork", 48.5)]
    for bad in ("SELECT id FROM ports GROUP BY town", "SELECT id, COUNT(*) FROM ports", "SELECT id FROM ports WHERE COUNT(*) > 1", "SELECT id FROM ports GROUP BY COUNT(*)", "SELECT id FROM ports WHERE id", "SELECT id + 1 FROM ports GROUP BY id + 2"):
        assert s.run(bad)[0].error, bad


@pytest.mark.parametrize("n,groups", [(100, 10), (3000, 4)])
def test_aggregates_against_python(spark, n, groups):
    rng = random.Random(n)
    pool = [(rng.randint(-50, 50), round(rng.uniform(-9, 9), 2), rng.choice("abcdef") * 2, datetime(2000, 1, rng.randint(1, 28))) for _ in range(n // 2)]
    data = [(rng.randrange(groups), *rng.choice(pool)) for _ in range(n)]
    s = Session(spark)
    s.catalog.register("r", spark.createDataFrame(data, "a long, b long, c double, d string, e timestamp_ntz"))
    for name, f, columns in (("SUM", sum, "bc"), ("COUNT", len, "bcde"), ("AVG", statistics.fmean, "bc"), ("STDDEV_POP", statistics.pstdev, "bc"), ("MIN", min, "bcde"), ("MAX", max, "bcde")):
        items = ", ".join(f"{name}({d}{c})" for c in columns for d in ("", "DISTINCT "))
        for g, *got in ok(s, f"SELECT A, {items} FROM R GROUP BY A")[-1].df.collect():
            own = [[r["abcde".index(c)] for r in data if r[0] == g] for c in columns]
            want = [f(x) for v in own for x in (v, list(set(v)))]
            assert all(math.isclose(x, y, abs_tol=1e-6) if isinstance(y, float) else x == y for x, y in zip(got, want, strict=True))


def test_changes(s):
    assert ok(s, "INSERT INTO calls (SELECT port, ship, days + 100, crew, came FROM calls)")[0].status == "INSERT 6"
    assert ok(s, "INSERT INTO calls (SELECT port, ship, CAST(days AS INT), crew, came FROM calls WHERE port = 7)")[0].status == "INSERT 2"
    assert len(rows(s, "SELECT * FROM calls")) == 14
    assert ok(s, "DELETE FROM calls WHERE days > 100")[0].status == "DELETE 7"
    assert len(rows(s, "SELECT port FROM calls")) == 7
    assert s.run("INSERT INTO ports VALUES (9, 'Riga', 1), (7, 'again', 1)")[0].error == "primary key constraint violation"
    assert s.run("INSERT INTO ports VALUES (9, 'Riga', 1), (9, 'again', 1)")[0].error
    assert s.run("INSERT INTO ports (SELECT id + 5, town, 1 FROM ports)")[0].error  # 7 + 5 exists
    assert len(rows(s, "SELECT id FROM ports")) == 4
    assert s.run("INSERT INTO calls (SELECT port, ship, days, days, came FROM calls)")[0].error  # FLOAT to INT needs a CAST
    assert s.run("INSERT INTO ports VALUES (1)")[0].error
    ok(s, "INSERT INTO ports VALUES (2 + 6, 12, 2.7), (10 - 1, 'a' || 'b', 7 / 2)")
    assert rows(s, "SELECT * FROM ports WHERE id < 10 AND id > 7") == [(8, "12", 2), (9, "ab", 3)]
    ok(s, "CREATE TABLE z(a INT); DELETE FROM z; DELETE FROM z WHERE a = a")
    for bad in ("CREATE TABLE ports(a INT)", "CREATE TABLE q(a INT, a INT)", "CREATE TABLE q(a FLOAT, PRIMARY KEY(a))", "CREATE TABLE q(a INT, PRIMARY KEY(b))", "CREATE INDEX ON ports(id)", "CREATE INDEX ON ports(town)", "CREATE INDEX ON calls(days)", "CREATE INDEX ON calls(nope)"):
        assert s.run(bad)[0].error, bad


def test_transactions(s):
    ok(s, "SET AUTOCOMMIT OFF; DELETE FROM ports WHERE id = 7; INSERT INTO calls (SELECT * FROM calls)")
    assert s.run("DELETE FROM nowhere")[0].error  # only that statement is undone
    assert len(rows(s, "SELECT id FROM ports")) == 3
    assert s.run("SET AUTOCOMMIT ON")[0].error
    ok(s, "ROLLBACK")
    assert len(rows(s, "SELECT id FROM ports")) == 4 and len(rows(s, "SELECT port FROM calls")) == 6
    ok(s, "DELETE FROM ports WHERE id = 7; COMMIT; DELETE FROM ports")
    s.close()
    assert len(rows(s, "SELECT id FROM ports")) == 3
    ok(s, "ROLLBACK; SET AUTOCOMMIT ON")
    assert s.run("COMMIT")[0].error and s.run("ROLLBACK")[0].error
    ok(s, "SET TRANSACTION READ ONLY")
    assert s.run("DELETE FROM ports")[0].error
    ok(s, "SET READ_ONLY OFF; DELETE FROM ports")
    assert s.run("SET NOTHING ON")[0].error and s.run("SET PLANNER BEST")[0].error


def test_division_by_zero_rolls_back(s):
    with pytest.raises(Exception):  # noqa: B017  Spark's own error, when the result is read
        ok(s, "SELECT id / (id - id) AS x FROM ports")[0].df.collect()
    assert s.run("INSERT INTO calls (SELECT id / (id - id), town, 1.0, berths, '2000-01-01' FROM ports)")[0].error
    assert rows(s, "SELECT id FROM ports WHERE id <> 7 AND 10 / (id - 7) = 2") == [(12,)]


def test_utilities(s):
    shown = ok(s, "SHOW TABLES")[0]
    assert shown.status == "SELECT 2" and shown.lines[1] == "ports(id[pk] INTEGER, town[sk] VARCHAR, berths INTEGER)"
    assert ok(s, "ANALYZE ports, calls")[0].status == "ANALYZE ports, calls"
    known = s.catalog.stats["calls"]
    assert known.rows == 6 and known.distinct["port"] == 4 and known.distinct["came"] == 6 and known.width["ship"] == 3 and known.width["days"] == 8
    assert [r[0] for r in ok(s, "SELECT id FROM ports ORDER BY berths DESC LIMIT 2")[0].df.collect()] == [23, 40]
    assert [r[0] for r in ok(s, "SELECT DISTINCT crew FROM calls ORDER BY crew")[0].df.collect()] == [7, 12, 20]
    with pytest.raises(EngineError):
        s.run("SELECT FROM")


def test_estimates(s):
    from quern import stats
    from quern.plans.analyzer import analyze
    from quern.plans.parser import parse

    assert "no statistics" in s.explain("SELECT id FROM ports")
    ok(s, "ANALYZE")
    known = {"ports": s.catalog.stats["ports"], "calls": s.catalog.stats["calls"]}
    block = analyze(parse("SELECT id, crew + id, 1 FROM ports, calls WHERE id = port AND days > 1")[0], s.catalog)
    assert stats.rows_after(block.where, known) == round(24 / 4 / 3)
    assert stats.groups([block.items[0][0]], known, 3) == 3
    assert stats.projected(block.items, known, 24) == {0: 4, 1: 12, 2: 1}
    told = s.explain("SELECT crew, COUNT(*) AS n FROM ports, calls WHERE id = port GROUP BY crew HAVING COUNT(*) > 1")
    assert "scan calls calls: 6 rows of 35 bytes" in told and "join and filter: 6 rows" in told and "group: 3 rows" in told and "having: 1 rows" in told and "Physical Plan" in told


def test_profile(s):
    found = s.profile("SELECT town, COUNT(*) AS n FROM ports, calls WHERE id = port GROUP BY town")
    assert found[0][0] == 0 and any("Join" in name and m.get("numOutputRows") == 5 for _, name, m in found)
    assert any("HashAggregate" in name and m.get("numOutputRows") == 3 for _, name, m in found)


def test_stored_tables_last(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    with Session(spark, store) as s:
        ok(s, PORTS + CALLS + "INSERT INTO ports (SELECT id + 100, town, berths FROM ports); DELETE FROM ports WHERE id = 107; ANALYZE ports")
        plan = s.sql("SELECT town FROM ports WHERE id = 112")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(id), EqualTo(id,112)]" in plan and "ReadSchema: struct<id:bigint,town:string>" in plan
        untouched = set(s.catalog.table("ports").files)
        ok(s, "DELETE FROM ports WHERE id = 999")
        assert set(s.catalog.table("ports").files) == untouched
        ok(s, "SET AUTOCOMMIT OFF; DELETE FROM calls; INSERT INTO ports VALUES (1, 'Oslo', 2); ROLLBACK; INSERT INTO ports VALUES (2, 'Faro', 5); COMMIT; DELETE FROM ports")
    with Session(spark, store) as again:  # what was committed is there, what wasn't is not
        want = sorted([40, 7, 12, 23, 140, 112, 123, 2])
        assert sorted(r[0] for r in rows(again, "SELECT id FROM ports")) == want and len(rows(again, "SELECT * FROM calls")) == 6
        assert again.catalog.table("ports").key == "id" and again.catalog.table("ports").indexes == ("town",) and again.catalog.stats["ports"].rows == 7
        assert again.run("INSERT INTO ports VALUES (2, 'Faro', 5)")[0].error == "primary key constraint violation"
        # the index's copy is read, and agrees with the table
        df = again.sql("SELECT id FROM ports WHERE town >= 'F' AND town <= 'G'")
        assert sorted(r[0] for r in df.collect()) == [2] and "ports.town" in df.inputFiles()[0]
        assert "ports.town" not in again.sql("SELECT id FROM ports WHERE town = 'Cork' AND id = 7").inputFiles()[0]
        ok(again, "DELETE FROM ports WHERE berths = 9; INSERT INTO ports VALUES (3, 'Cork', 1)")
        assert rows(again, "SELECT id FROM ports WHERE town = 'Cork'") == [(3,)]
        other = Session(spark, store)
        ok(other, "INSERT INTO ports VALUES (4, 'Genoa', 1)")
        assert "another session" in again.run("INSERT INTO ports VALUES (5, 'Genoa', 1)")[0].error


def test_many_inserts_stay_one_scan(spark, tmp_path):
    s, stored = Session(spark), Session(spark, f"file://{tmp_path}/many")
    for session in (s, stored):
        ok(session, "CREATE TABLE t(a INT); " + " ".join(f"INSERT INTO t VALUES ({i});" for i in range(6)))
        df = session.sql("SELECT a FROM t")
        assert sorted(r[0] for r in df.collect()) == list(range(6)) and "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import io

    from quern import __main__ as command

    assert [command.complete(t) for t in ("SELECT 1", "SELECT ';", "SELECT 'a;b';", "SELECT a\nFROM t; -- end;\n", "SELECT a /* ;", "; ", "")] == [False, False, True, True, False, True, False]
    script = tmp_path / "script.sql"
    script.write_text("CREATE TABLE t(a INT, s VARCHAR); INSERT INTO t VALUES (1, 'two\nlines;'); SELECT a, s FROM t;\nSELECT nope FROM t; SHOW TABLES;")
    for args, given in ((["quern", "-i", str(script)], ""), (["quern"], script.read_text())):
        monkeypatch.setattr("sys.argv", args)
        monkeypatch.setattr("sys.stdin", io.StringIO(given))
        command.main()
        said = capsys.readouterr().out
        assert "(1, 'two\\nlines;')" in said and "SELECT 1" in said and "ERROR: column nope not found" in said and "t(a INTEGER, s VARCHAR)" in said
