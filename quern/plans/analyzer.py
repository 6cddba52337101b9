"""Name resolution and checks: from a parsed SELECT to a typed block."""

from __future__ import annotations

from dataclasses import dataclass, field

from quern.plans import expr as X
from quern.plans import parser as P
from quern.plans.expr import Expr
from quern.sources.catalog import Catalog, Table
from quern.types import NAMES, EngineError, Type


@dataclass
class Block:
    """SELECT-FROM-WHERE-GROUP BY-HAVING, checked. group is None where there is no aggregation. distinct, order, limit and offset
    are extensions."""

    tables: list[tuple[str, Table]]
    items: list[tuple[Expr, str]]
    where: Expr | None = None
    group: list[Expr] | None = None
    having: Expr | None = None
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None

    @property
    def types(self) -> list[Type]:
        return [e.type for e, _ in self.items]


def type_named(name: str) -> Type:
    if name not in NAMES:
        raise EngineError(f"type {name.upper()} isn't supported")
    return NAMES[name]


class Scope:
    def __init__(self, tables: list[tuple[str, Table]], aliases: dict[str, Expr] | None = None):
        self.tables, self.aliases = tables, aliases or {}

    def column(self, n: P.Name) -> Expr:
        if n.table is None and n.column in self.aliases:
            return self.aliases[n.column]
        found = [(a, t) for a, t in self.tables if n.table in (None, a) and n.column in t.types]
        if not found:
            raise EngineError(f"column {n.table + '.' if n.table else ''}{n.column} not found")
        if len(found) > 1:
            raise EngineError(f"column {n.column} is ambiguous")
        alias, table = found[0]
        return Expr("col", table.types[n.column], value=(alias, n.column))

    def typed(self, e) -> Expr:
        match e:
            case P.Literal(value):
                return X.literal(value)
            case P.Name():
                return self.column(e)
            case P.CastTo(arg, kind):
                return X.explicit_cast(self.typed(arg), type_named(kind))
            case P.Call("count", (P.Star(),), False):
                return X.call("count", (X.literal(1),))
            case P.Call("neg", (P.Literal(value),), False) if not isinstance(value, (bool, str)):
                return X.literal(-value)
            case P.Call(op, args, distinct):
                return X.call(op, tuple(self.typed(a) for a in args), distinct)
        raise EngineError("* can't be used here")


def _boolean(e: Expr, clause: str) -> Expr:
    if e.type is not Type.BOOLEAN:
        raise EngineError(f"{clause} needs a BOOLEAN condition")
    return e


def analyze(s: P.Select, catalog: Catalog) -> Block:
    tables = [(alias, catalog.table(name)) for name, alias in s.tables]
    if len({a for a, _ in tables}) < len(tables):
        raise EngineError("a table alias occurs twice in FROM")
    scope, items = Scope(tables), []
    for e, name in s.items:
        if isinstance(e, P.Star):
            chosen = [(a, t) for a, t in tables if e.table in (None, a)]
            if not chosen:
                raise EngineError(f"table {e.table} isn't in FROM")
            items += [(Expr("col", t.types[c], value=(a, c)), c) for a, t in chosen for c in t.types]
            continue
        typed = scope.typed(e)
        items.append((typed, name or (e.column if isinstance(e, P.Name) else f"_col_{len(items)}")))
        if name:  # later items and the other clauses may use it, before any column of that name
            scope.aliases[name] = typed
    out = Block(tables, items, distinct=s.distinct, limit=s.limit, offset=s.offset)
    if s.where is not None:
        out.where = _boolean(scope.typed(s.where), "WHERE")
        if out.where.aggregates:
            raise EngineError("WHERE contains an aggregate")
    if s.group is not None:
        out.group = []
        for g in s.group:
            if isinstance(g, P.Literal) and type(g.value) is int:
                if not 1 <= g.value <= len(items):
                    raise EngineError(f"GROUP BY {g.value} isn't in the SELECT list")
                key = items[g.value - 1][0]
            else:
                key = scope.typed(g)
            if key.aggregates:
                raise EngineError("GROUP BY contains an aggregate")
            out.group.append(key)
    if s.having is not None:
        out.having = _boolean(scope.typed(s.having), "HAVING")
    out.order = [(items[e.value - 1][0] if isinstance(e, P.Literal) and type(e.value) is int and 1 <= e.value <= len(items) else scope.typed(e), up) for e, up in s.order]
    if s.distinct and any(e not in [i for i, _ in items] for e, _ in out.order):
        raise EngineError("with DISTINCT, ORDER BY uses what is selected")
    if out.group is None and (out.having is not None or any(e.aggregates for e, _ in items)):
        out.group = []
    if out.group is not None:
        for clause, e in [*(("SELECT", e) for e, _ in items), *(("HAVING", e) for e in [out.having] if e), *(("ORDER BY", e) for e, _ in out.order)]:
            if not X.computable(e, out.group):
                raise EngineError(f"{clause} has a part that can't be computed for a group")
    elif any(e.aggregates for e, _ in out.order):
        raise EngineError("ORDER BY contains an aggregate")
    return out
