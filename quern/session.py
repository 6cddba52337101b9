"""Sessions: statements in, DataFrames or a status out; options; transactions over table versions."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import profile, stats
from quern.functions import scalar
from quern.plans import expr as X
from quern.plans import parser as P
from quern.plans.analyzer import Block, Scope, analyze, type_named
from quern.plans.planner import Options, plan
from quern.sources.catalog import Catalog, Table
from quern.types import EngineError, Type

log = logging.getLogger("quern")


@dataclass
class Response:
    """status: what was done. df: a query's lazy result. lines: what a command lists. error: why it was rolled back."""

    status: str = ""
    df: DataFrame | None = None
    lines: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class _Saved:
    tables: dict[str, Table]
    stats: dict
    worked: bool = False


class Session:
    """A single writer. With autocommit on (the default) each statement is its own transaction; off, the first statement opens one that
    COMMIT or ROLLBACK ends. A statement that fails changes nothing and leaves the open transaction alone."""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark, self.catalog = spark, Catalog(spark, store)
        self.options = Options()
        self.autocommit, self.read_only, self.debug = True, False, False
        self.open: _Saved | None = None

    # running

    def sql(self, text: str) -> DataFrame:
        """The result of one SELECT; raises EngineError."""
        r = self.run(text)[-1]
        if r.error is not None or r.df is None:
            raise EngineError(r.error or "not a query")
        return r.df

    def explain(self, text: str) -> str:
        """One SELECT's estimated rows and bytes step by step, from the statistics that ANALYZE gathered, and its physical plan."""
        (s,) = P.parse(text)
        block = analyze(s, self.catalog)
        physical = self.spark._jvm.PythonSQLUtils.explainString(plan(block, self.options)._jdf.queryExecution(), "formatted")
        return "\n".join([*stats.told(block, self.catalog.stats), physical])

    def profile(self, text: str) -> list[tuple[int, str, dict[str, int]]]:
        """Run one SELECT and return (depth, operator, metrics) for each operator of the plan that ran, as measured: rows, bytes, times."""
        return profile.measured(self.sql(text))

    def run(self, text: str) -> list[Response]:
        """Every statement of a script, one after another. A script that can't be parsed runs nothing and raises."""
        return [self.execute(s) for s in P.parse(text)]

    def execute(self, s) -> Response:
        if not self.autocommit and self.open is None:
            self.open = _Saved(dict(self.catalog.tables), dict(self.catalog.stats))
        before = dict(self.catalog.tables), dict(self.catalog.stats)
        try:
            out = self._dispatch(s)
            if self.autocommit and isinstance(s, (P.CreateTable, P.CreateIndex, P.Insert, P.Delete, P.Analyze)):
                self.catalog.commit()
        except Exception as e:  # any failure of a statement rolls that statement back
            self.catalog.tables, self.catalog.stats = before
            return Response("ROLLED BACK", error=str(e))
        if self.open is not None and not isinstance(s, (P.Commit, P.Rollback, P.SetOption)):
            self.open.worked = True
        return out

    def close(self) -> None:
        """End the session; work that wasn't committed is rolled back with a warning."""
        if self.open is not None and self.open.worked:
            log.warning("session ends with an open transaction, which is rolled back")
            self.catalog.tables, self.catalog.stats = self.open.tables, self.open.stats
        self.open = None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _dispatch(self, s) -> Response:
        match s:
            case P.Select():
                block = analyze(s, self.catalog)
                df = plan(block, self.options)
                if self.debug:
                    log.info("%s", "\n".join([*stats.told(block, self.catalog.stats), df._jdf.queryExecution().toString()]))
                return Response("SELECT", df)
            case P.ShowTables():
                lines = [t.described() for _, t in sorted(self.catalog.tables.items())]
                return Response(f"SELECT {len(lines)}", self.tables(), lines)
            case P.SetOption(option, value):
                return self._set(option, value)
            case P.Commit():
                if self.open is None:
                    raise EngineError("no transaction to COMMIT")
                self.catalog.commit()
                self.open = None
                return Response("COMMIT")
            case P.Rollback():
                if self.open is None:
                    raise EngineError("no transaction to ROLLBACK")
                self.catalog.tables, self.catalog.stats = self.open.tables, self.open.stats
                self.open = None
                return Response("ROLLBACK")
        if self.read_only:
            raise EngineError("the session is read only")
        match s:
            case P.CreateTable(name, columns, key):
                return self._create(name, columns, key)
            case P.CreateIndex(table, column):
                return self._index(table, column)
            case P.Insert():
                return self._insert(s)
            case P.Delete(table, where):
                return self._delete(table, where)
            case P.Analyze(names):
                chosen = [self.catalog.table(n) for n in (names if names is not None else sorted(self.catalog.tables))]
                for t in chosen:
                    self.catalog.stats[t.name] = stats.gather(t)
                said = [f"{t.name}: {self.catalog.stats[t.name].rows} rows, distinct {self.catalog.stats[t.name].distinct}" for t in chosen]
                return Response("ANALYZE" + (" " + ", ".join(names) if names is not None else ""), lines=said)
        raise EngineError("the statement isn't supported")

    # definitions

    def tables(self) -> DataFrame:
        """SHOW TABLES as rows: table, position, column, type, role."""
        rows = [(t.name, i, c, k.value, "pk" if c == t.key else "sk" if c in t.indexes else "") for _, t in sorted(self.catalog.tables.items()) for i, (c, k) in enumerate(t.types.items(), 1)]
        return self.spark.createDataFrame(rows, "table_name string, position long, column_name string, type string, role string")

    def _create(self, name: str, columns: list[tuple[str, str]], key: str | None) -> Response:
        types = {c: type_named(k) for c, k in columns}
        if name.startswith(".") or any(c.startswith(".") for c in types):
            raise EngineError("names don't start with a dot")
        if name in self.catalog.tables:
            raise EngineError(f"{name} already exists")
        if len(types) < len(columns):
            raise EngineError("a column name occurs twice")
        if key is not None and key not in types:
            raise EngineError(f"primary key column {key} isn't declared")
        if key is not None and types[key] not in (Type.INTEGER, Type.VARCHAR):
            raise EngineError("a key is INTEGER or VARCHAR")
        self.catalog.create(name, types, key)
        return Response("CREATE TABLE")

    def _index(self, name: str, column: str) -> Response:
        t = self.catalog.table(name)
        if column not in t.types:
            raise EngineError(f"column {column} isn't in table {name}")
        if column == t.key:
            raise EngineError(f"{column} is the primary key")
        if column in t.indexes:
            raise EngineError(f"an index on {name}({column}) exists")
        if t.types[column] not in (Type.INTEGER, Type.VARCHAR):
            raise EngineError("a key is INTEGER or VARCHAR")
        self.catalog.index(t, column)
        return Response("CREATE INDEX")

    # changes

    def _insert(self, s: P.Insert) -> Response:
        t = self.catalog.table(s.table)
        if s.rows is not None:
            rows = self._constants(t, s.rows)
            return Response(f"INSERT {self.catalog.append(t, self.catalog.literal(rows, t.types), rows)}")
        assert s.select is not None
        block = analyze(s.select, self.catalog)
        if len(block.items) != len(t.types):
            raise EngineError(f"{len(block.items)} columns supplied, {len(t.types)} expected")
        for (e, _), (c, k) in zip(block.items, t.types.items(), strict=True):
            if not e.type.implicit(k):
                raise EngineError(f"{c} needs {k.value}, not {e.type.value}" + ("; an explicit CAST would do" if e.type.explicit(k) else ""))
        df = plan(replace(block, items=[(e, f"in{i}") for i, (e, _) in enumerate(block.items)]), self.options)
        # the plan reads the old versions, which never change, so a table can be inserted into itself
        new = df.select(*[scalar.cast(F.col(f"in{i}"), e.type, k).alias(c) for i, ((e, _), (c, k)) in enumerate(zip(block.items, t.types.items(), strict=True))])
        return Response(f"INSERT {self.catalog.append(t, new)}")

    def _constants(self, t: Table, rows: list[list]) -> list[tuple]:
        """The values of a VALUES list. Plain literals need no job; all other constants of the statement are computed in one."""
        out: list[list] = []
        open_: list[tuple[int, int, X.Expr]] = []
        for i, row in enumerate(rows, 1):
            if len(row) != len(t.types):
                raise EngineError(f"row {i} of VALUES: {len(row)} columns, {len(t.types)} expected")
            mine: list = []
            for j, (e, (c, k)) in enumerate(zip(row, t.types.items(), strict=True)):
                typed = Scope([]).typed(e)
                if not typed.type.explicit(k):
                    raise EngineError(f"row {i} of VALUES, {c}: {typed.type.value} isn't compatible with {k.value}")
                typed = X.cast(typed, k) if typed.type is not k else typed
                plain, value = self._plain(typed)
                mine.append(value)
                if not plain:
                    open_.append((i - 1, j, typed))
            out.append(mine)
        if open_:
            found = self.spark.range(1).select(*[X.to_column(e, {}).alias(f"v{n}") for n, (_, _, e) in enumerate(open_)]).first()
            for n, (i, j, _) in enumerate(open_):
                out[i][j] = found[f"v{n}"]
        return [tuple(r) for r in out]

    def _plain(self, e: X.Expr) -> tuple[bool, object]:
        """Whether e is a literal, as it stands or cast, and its value."""
        if e.op == "lit":
            return True, e.value
        if e.op == "cast" and e.args[0].op == "lit":
            v, source = e.args[0].value, e.args[0].type
            match e.type:
                case Type.INTEGER | Type.FLOAT:
                    return True, int(v) if e.type is Type.INTEGER else float(v)
                case Type.DATETIME:
                    return True, X.parse_datetime(v)
                case Type.VARCHAR if source is not Type.DATETIME:
                    return True, str(v)
        return False, None

    def _delete(self, name: str, where) -> Response:
        t = self.catalog.table(name)
        block = Block([(name, t)], [])
        if where is not None:
            block.where = Scope(block.tables).typed(where)
            if block.where.type is not Type.BOOLEAN or block.where.aggregates:
                raise EngineError("DELETE needs a BOOLEAN condition without aggregates")
            known = {X.Expr("col", k, value=(name, c)): F.col(f"`{c}`") for c, k in t.types.items()}
            gone = F.coalesce(X.to_column(block.where, known), F.lit(False))
        else:
            gone = F.lit(True)
        return Response(f"DELETE {self.catalog.delete(t, gone)}")

    # options

    def _set(self, option: str, value: str) -> Response:
        flags = {"on": True, "off": False}
        if option == "transaction":
            option, value = "read_only", {"read only": "on", "read write": "off"}.get(value, value)
        if option == "planner":
            if value == "smart":
                value = "baseline"  # the optimizer below is the same
            if value not in ("naive", "baseline"):
                raise EngineError(f"no planner {value}")
            self.options.planner = value
        elif option not in ("autocommit", "read_only", "debug", "index_join", "sort_merge_join", "hash_join"):
            raise EngineError(f"no option {option}")
        elif value not in flags:
            raise EngineError(f"{option} is on or off")
        elif option == "autocommit":
            if flags[value] and not self.autocommit and self.open is not None and self.open.worked:
                raise EngineError("COMMIT or ROLLBACK the open transaction before setting AUTOCOMMIT ON")
            self.autocommit = flags[value]
            if self.autocommit:
                self.open = None
        elif option == "read_only":
            if self.read_only and not flags[value] and self.open is not None and self.open.worked:
                raise EngineError("COMMIT or ROLLBACK the open transaction before allowing writes")
            self.read_only = flags[value]
        elif option == "debug":
            self.debug = flags[value]
        else:
            setattr(self.options, option, flags[value])
        return Response("SET")
