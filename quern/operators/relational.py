"""Scan, filter, joins, grouped aggregation and projection, each from typed expressions to DataFrames.

Inside a query every column is named `alias.column`, so tables joined with themselves stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.expr import COMPARISONS, Expr, conjuncts, to_column
from quern.sources.catalog import Table

Known = dict[Expr, Column]


def scan(alias: str, table: Table, own: list[Expr] = ()) -> tuple[DataFrame, Known]:
    """own: conditions on this table alone. Where one compares an indexed column of a stored table with a constant, and none the primary key, the
    index's sorted copy is read, in which row-group statistics skip what the condition rules out."""
    bound = {x.value[1] for c in own if c.op in COMPARISONS and c.op != "<>" and any(not a.tables for a in c.args) for x in c.args if x.op == "col"}
    by = next((c for c in table.indexes if c in bound and table.copies.get(c)), None) if table.key not in bound else None
    source = table.df.sparkSession.read.schema(table.df.schema).parquet(*table.copies[by]) if by else table.df
    df = source.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in table.types])
    return df, {Expr("col", t, value=(alias, c)): F.col(f"`{alias}.{c}`") for c, t in table.types.items()}


def select_rows(df: DataFrame, condition: Expr | None, known: Known) -> DataFrame:
    for c in conjuncts(condition):
        df = df.where(to_column(c, known))
    return df


def join(left: DataFrame, right: DataFrame, conditions: list[Expr], known: Known, hint: str | None) -> DataFrame:
    """Inner join on all conditions; Catalyst finds equi-keys among them, and the rest filters while joining. hint: a join strategy, None to
    let the optimizer choose by size."""
    if hint:
        right = right.hint(hint)
    if not conditions:
        return left.crossJoin(right)
    on = to_column(conditions[0], known)
    for c in conditions[1:]:
        on = on & to_column(c, known)
    return left.join(right, on, "inner")


def between(conditions: list[Expr], left: set[str], right: str) -> tuple[Expr, Expr, Expr, bool] | None:
    """(point, low, high, of_right): among the conditions, bounds from one side on both ends of a number of the other side. of_right: the point is the
    right table's. None where there are no such two."""
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    bounds: dict[tuple[Expr, bool], dict[str, Expr]] = {}
    for c in conditions:
        if c.op not in turned:
            continue
        for op, point, limit in ((c.op, *c.args), (turned[c.op], *reversed(c.args))):
            if not (point.type.numeric and limit.type.numeric and point.tables and limit.tables) or c.raises:
                continue
            if (of_right := point.tables == {right}) != (limit.tables == {right}) and point.tables <= left | {right} and limit.tables <= left | {right} and (of_right or point.tables <= left):
                bounds.setdefault((point, of_right), {}).setdefault("high" if op[0] == "<" else "low", limit)
    for (point, of_right), ends in bounds.items():
        if len(ends) == 2:
            return point, ends["low"], ends["high"], of_right
    return None


#: The widest bins are so many binary digits wide; wider intervals, and what isn't finite, share one bin.
WIDEST, NARROWEST = 50, -8


def range_join(left: DataFrame, right: DataFrame, conditions: list[Expr], known: Known, found: tuple[Expr, Expr, Expr, bool]) -> DataFrame:
    """Inner join where a number of one side lies between two of the other: an equi-join on bins instead of all pairs. An interval takes the bin width,
    a power of two, that its own length asks for, so it covers three bins at most; a point has a bin of each width that any interval takes.
    All conditions are checked again on what meets."""
    point, low, high, of_right = found
    points, intervals = (right, left) if of_right else (left, right)
    x, a, b = (to_column(e, known).cast("double") for e in (point, low, high))
    length = b - a
    wide = F.isnan(length) | (F.abs(a) > 2.0**WIDEST) | (F.abs(b) > 2.0**WIDEST) | (length > 2.0**WIDEST)
    level = F.when(wide, F.lit(WIDEST + 1)).when(length <= 2.0**NARROWEST, F.lit(NARROWEST)).otherwise(F.ceil(F.log2(length)).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_level"))
    one = F.array(F.lit(0).cast("long"))
    bins = lambda c: F.floor(c / width)
    cut = intervals.where((length >= 0) | wide).withColumn("_level", level)
    levels = [r["_level"] for r in cut.select("_level").distinct().collect()]  # at most one for each power of two
    cut = cut.withColumn("_bin", F.explode(F.when(F.col("_level") > WIDEST, one).otherwise(F.sequence(bins(a), bins(b)))))
    dealt = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    dealt = dealt.withColumn("_bin", F.when(F.col("_level") > WIDEST, F.lit(0).cast("long")).otherwise(bins(x)))
    on = to_column(conditions[0], known)
    for c in conditions[1:]:
        on = on & to_column(c, known)
    return dealt.join(cut, ["_level", "_bin"]).where(on).drop("_level", "_bin")


def equi(e: Expr, left: set[str], right: str) -> bool:
    """Whether e equates something of the left tables with something of the right one."""
    if e.op != "=":
        return False
    a, b = e.args[0].tables, e.args[1].tables
    return bool(a and b) and ((a <= left and b == {right}) or (b <= left and a == {right}))


_DISTINCT = {"sum": "sum", "count": "count", "avg": "avg", "stddev_pop": "stddev_pop"}


def _aggregate(e: Expr, argument: str) -> Column:
    name = e.op.removeprefix("agg:")
    if e.value:
        return F.expr(f"{_DISTINCT[name]}(DISTINCT `{argument}`)")
    return getattr(F, name)(F.col(f"`{argument}`"))


def group(df: DataFrame, keys: list[Expr], aggregates: list[Expr], known: Known) -> tuple[DataFrame, Known]:
    """One row per group that has a row: without keys, no row for an empty input. Equal aggregates are computed once."""
    named = {k: f"key{i}" for i, k in enumerate(keys)}
    arguments = {a: f"arg{i}" for i, a in enumerate(dict.fromkeys(e.args[0] for e in aggregates))}
    # a key or an argument that is a constant isn't read as a column number, as both are columns first
    df = df.select(*[to_column(e, known).alias(n) for e, n in [*named.items(), *arguments.items()]])
    by = [F.col(n) for n in named.values()] or [F.lit("all").alias("all")]
    outs = {e: f"agg{i}" for i, e in enumerate(aggregates)}
    df = df.groupBy(*by).agg(*([_aggregate(e, arguments[e.args[0]]).alias(n) for e, n in outs.items()] or [F.count(F.lit(1)).alias("rows")]))
    return df, {e: F.col(n) for e, n in [*named.items(), *outs.items()]}


def project(df: DataFrame, items: list[tuple[Expr, str]], known: Known) -> DataFrame:
    return df.select(*[to_column(e, known).alias(n) for e, n in items])


def sort(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    return df.orderBy(*[c.asc() if up else c.desc() for c, up in keys])
