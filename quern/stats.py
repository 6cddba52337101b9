"""ANALYZE: row counts and distinct counts, and the estimates that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from quern.plans.expr import COMPARISONS, Expr, conjuncts
from quern.sources.catalog import Table
from quern.types import Type


@dataclass(frozen=True)
class Stats:
    """distinct: for each column the approximate number of distinct values, from 1 to rows; types without a sketch count as all distinct. width: mean bytes
    of each column's values."""

    rows: int
    distinct: dict[str, int]
    width: dict[str, float] = field(default_factory=dict)

    def row_bytes(self, columns) -> float:
        return sum(self.width.get(c, 8.0) for c in columns)


def gather(table: Table) -> Stats:
    """One pass over the table."""
    sketched = [c for c, t in table.types.items() if t in (Type.INTEGER, Type.FLOAT, Type.VARCHAR)]
    texts = [c for c, t in table.types.items() if t is Type.VARCHAR]
    distinct = [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(sketched)]
    widths = [F.avg(F.octet_length(F.col(f"`{c}`"))).alias(f"w{i}") for i, c in enumerate(texts)]
    row = table.df.agg(F.count(F.lit(1)).alias("n"), *distinct, *widths).first()
    n = row["n"]
    found = {c: row[f"d{i}"] for i, c in enumerate(sketched)}
    width = {c: 1.0 if t is Type.BOOLEAN else 8.0 for c, t in table.types.items()} | {c: float(row[f"w{i}"] or 0) for i, c in enumerate(texts)}
    return Stats(n, {c: max(1, min(found.get(c, n), n)) for c in table.types}, width)


def selectivity(condition: Expr | None, stats: dict[str, Stats]) -> float:
    """Share of rows that pass, with conditions taken as independent. stats: by table alias."""
    share = 1.0
    for c in conjuncts(condition):
        share *= _one(c, stats)
    return share


def _one(c: Expr, stats: dict[str, Stats]) -> float:
    if c.op not in COMPARISONS:
        return 1 / 3
    columns = [stats[a.value[0]].distinct[a.value[1]] for a in c.args if a.op == "col" and a.value[0] in stats]
    if c.op in ("=", "<>") and columns:
        hit = 1 / max(columns)
        return hit if c.op == "=" else 1 - hit
    return 1 / 3


def rows_after(condition: Expr | None, stats: dict[str, Stats]) -> int:
    """Estimated rows of a join of all these tables under a condition, 1 at least."""
    n = 1.0
    for s in stats.values():
        n *= s.rows
    return max(1, round(n * selectivity(condition, stats)))


def groups(keys: list[Expr], stats: dict[str, Stats], rows: int) -> int:
    """Estimated groups: the product of the keys' distinct counts, but no more than rows."""
    n = 1
    for k in keys:
        n *= stats[k.value[0]].distinct[k.value[1]] if k.op == "col" and k.value[0] in stats else rows
    return max(1, min(n, rows))


def projected(items: list[tuple[Expr, str]], stats: dict[str, Stats], rows: int) -> dict[str, int]:
    """Estimated distinct values of each selected column, by its position: those of a plain column carry over, those of a constant are one, and
    an expression has at most as many as its columns together; never more than rows."""
    out = {}
    for i, (e, _) in enumerate(items):
        n = 1
        for x in dict.fromkeys(x for x in e.walk() if x.op == "col"):
            n *= stats[x.value[0]].distinct[x.value[1]] if x.value[0] in stats else max(1, rows)
        out[i] = max(1, min(n, rows)) if not e.aggregates else max(1, rows)
    return out


def told(block, known: dict[str, Stats]) -> list[str]:
    """A block's steps with estimated rows, and bytes where widths are known; a table without statistics says so."""
    out, seen = [], {}
    for alias, table in block.tables:
        if table.name not in known:
            return [f"{table.name}: no statistics; ANALYZE {table.name} gathers them"]
        seen[alias] = known[table.name]
        out.append(f"scan {table.name} {alias}: {seen[alias].rows} rows of {seen[alias].row_bytes(table.types):.0f} bytes")
    rows = rows_after(block.where, seen)
    out.append(f"join and filter: {rows} rows")
    if block.group is not None:
        rows = groups(block.group, seen, rows) if block.group else 1
        out.append(f"group: {rows} rows")
        if block.having is not None:
            rows = max(1, round(rows * selectivity(block.having, seen)))
            out.append(f"having: {rows} rows")
    out.append(f"project: {rows} rows, distinct {list(projected(block.items, seen, rows).values())}")
    return out
