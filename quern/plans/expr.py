"""Typed expressions. Building a node checks its operands and inserts the casts that the type rules ask for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.types import EngineError, Type


@dataclass(frozen=True)
class Expr:
    """op: 'lit', 'col', 'cast', 'agg:<name>', or the sign or name of a function. value: a literal, a column's (alias, name),
    or whether an aggregate is DISTINCT. Equal trees are equivalent expressions."""

    op: str
    type: Type
    args: tuple[Expr, ...] = ()
    value: Any = None

    def walk(self) -> Iterator[Expr]:
        yield self
        for a in self.args:
            yield from a.walk()

    @property
    def aggregates(self) -> bool:
        return any(e.op.startswith("agg:") for e in self.walk())

    @property
    def tables(self) -> set[str]:
        return {e.value[0] for e in self.walk() if e.op == "col"}

    @property
    def raises(self) -> bool:
        """Whether it can fail on some rows."""
        return any((e.op in ("/", "%") and not (e.args[1].op == "lit" and e.args[1].value)) or (e.op == "cast" and e.args[0].op != "lit" and (e.args[0].type, e.type) == (Type.VARCHAR, Type.DATETIME)) for e in self.walk())


def literal(value: Any) -> Expr:
    if isinstance(value, bool):
        return Expr("lit", Type.BOOLEAN, value=value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise EngineError(f"{value} is out of range")
        return Expr("lit", Type.INTEGER, value=value)
    return Expr("lit", Type.FLOAT if isinstance(value, float) else Type.VARCHAR, value=value)


def cast(e: Expr, to: Type) -> Expr:
    return e if e.type is to else Expr("cast", to, (e,))


def explicit_cast(e: Expr, to: Type) -> Expr:
    if not e.type.explicit(to):
        raise EngineError(f"can't cast {e.type.value} to {to.value}")
    return cast(e, to)


def _must(op: str, want: Type, *args: Expr) -> None:
    for a in args:
        if a.type is not want:
            raise EngineError(f"{op.upper()} needs {want.value}, not {a.type.value}")


COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
SCALARS = {"lower": 1, "upper": 1, "replace": 3}
AGGREGATES = ("sum", "count", "avg", "stddev_pop", "min", "max")


def call(op: str, args: tuple[Expr, ...], distinct: bool = False) -> Expr:
    """An operator or function applied, with casts where operands differ."""
    if op in AGGREGATES:
        return aggregate(op, args, distinct)
    if distinct:
        raise EngineError(f"{op.upper()} takes no DISTINCT")
    if op in ("neg", "+", "-", "*", "/"):
        for a in args:
            if not a.type.numeric:
                raise EngineError(f"{op} needs numbers, not {a.type.value}")
        kind = Type.FLOAT if any(a.type is Type.FLOAT for a in args) else Type.INTEGER
        return Expr(op, kind, tuple(cast(a, kind) for a in args))
    if op == "%":
        _must(op, Type.INTEGER, *args)
        return Expr(op, Type.INTEGER, args)
    if op in ("||", "~"):
        _must(op, Type.VARCHAR, *args)
        return Expr(op, Type.VARCHAR if op == "||" else Type.BOOLEAN, args)
    if op in ("and", "or", "not"):
        _must(op, Type.BOOLEAN, *args)
        return Expr(op, Type.BOOLEAN, args)
    if op in COMPARISONS:
        left, right = args
        if right.type.implicit(left.type):  # the left type wins, so a date text on the left compares as text
            return Expr(op, Type.BOOLEAN, (left, cast(right, left.type)))
        if left.type.implicit(right.type):
            return Expr(op, Type.BOOLEAN, (cast(left, right.type), right))
        raise EngineError(f"can't compare {left.type.value} and {right.type.value}")
    if op in SCALARS:
        if len(args) != SCALARS[op]:
            raise EngineError(f"{op.upper()} takes {SCALARS[op]} arguments")
        _must(op, Type.VARCHAR, *args)
        return Expr(op, Type.VARCHAR, args)
    raise EngineError(f"{op.upper()} isn't supported")


def aggregate(op: str, args: tuple[Expr, ...], distinct: bool) -> Expr:
    if len(args) != 1:
        raise EngineError(f"{op.upper()} takes one argument")
    (arg,) = args
    if arg.aggregates:
        raise EngineError("an aggregate stands inside another")
    if op in ("sum", "avg", "stddev_pop") and not arg.type.numeric:
        raise EngineError(f"{op.upper()} needs numbers, not {arg.type.value}")
    kind = {"count": Type.INTEGER, "avg": Type.FLOAT, "stddev_pop": Type.FLOAT}.get(op, arg.type)
    return Expr(f"agg:{op}", kind, args, distinct and op not in ("min", "max"))


def computable(e: Expr, keys: list[Expr]) -> bool:
    """Whether e can be computed from the keys, aggregates and constants."""
    if e in keys or e.op == "lit" or e.op.startswith("agg:"):
        return True
    return e.op != "col" and all(computable(a, keys) for a in e.args)


def conjuncts(e: Expr | None) -> list[Expr]:
    """The parts of a conjunction. One that can fail is kept behind those before it that need no more tables."""

    def flat(x: Expr) -> list[Expr]:
        return [c for a in x.args for c in flat(a)] if x.op == "and" else [x]

    out: list[Expr] = []
    for c in flat(e) if e is not None else []:
        guard = None
        for g in [g for g in out if g.tables <= c.tables] if c.raises else []:
            guard = g if guard is None else Expr("and", Type.BOOLEAN, (guard, g))
        out.append(c if guard is None else Expr("and", Type.BOOLEAN, (guard, c)))
    return out


def to_column(e: Expr, known: dict[Expr, Column]) -> Column:
    """As a Spark column; known maps what is already computed (columns, group keys, aggregates)."""
    if e in known:
        return known[e]
    if e.op == "lit":
        return F.lit(e.value).cast(e.type.spark())
    if e.op == "col":
        raise EngineError(f"column {'.'.join(e.value)} can't be used here")
    a = [to_column(x, known) for x in e.args]
    match e.op:
        case "cast":
            return scalar.cast(a[0], e.args[0].type, e.type)
        case "neg":
            return -a[0]
        case "not":
            return ~a[0]
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return a[0] / a[1] if e.type is Type.FLOAT else scalar.floor_divide(a[0], a[1])
        case "%":
            return scalar.modulo(a[0], a[1])
        case "||":
            return F.concat(a[0], a[1])
        case "~":
            return scalar.matches(a[0], a[1])
        case "and":  # the right side runs only where the left holds, if it could fail elsewhere
            return F.when(a[0], a[1]).otherwise(F.lit(False)) if e.args[1].raises else a[0] & a[1]
        case "or":
            return F.when(a[0], F.lit(True)).otherwise(a[1]) if e.args[1].raises else a[0] | a[1]
        case "=":
            return a[0] == a[1]
        case "<>":
            return a[0] != a[1]
        case "<":
            return a[0] < a[1]
        case "<=":
            return a[0] <= a[1]
        case ">":
            return a[0] > a[1]
        case ">=":
            return a[0] >= a[1]
        case "lower":
            return F.lower(a[0])
        case "upper":
            return F.upper(a[0])
        case "replace":
            return F.replace(a[0], a[1], a[2])
    raise EngineError(f"{e.op} can't be planned")


def parse_datetime(text: str) -> datetime:
    """ISO dates and times, and some free forms, for literals."""
    try:
        return datetime.fromisoformat(text.strip()).replace(tzinfo=None)
    except ValueError:
        pass
    for form in ("%b %d %Y", "%B %d %Y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%m/%d/%Y", "%Y/%m/%d", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d %H:%M:%S"):
        try:
            return datetime.strptime(text.strip(), form)
        except ValueError:
            continue
    raise EngineError(f"{text!r} isn't a date and time")
