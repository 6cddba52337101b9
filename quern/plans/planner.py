"""From a typed block to one lazy DataFrame; Catalyst does the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.plans.analyzer import Block
from quern.plans.expr import Expr, conjuncts


@dataclass
class Options:
    """planner: baseline joins in FROM order under the conditions that apply so far; naive crosses all tables, then filters. Both have the same
    result. Where join strategies are switched off, equi-joins get a hint for one that is left; with all on, the optimizer chooses. index_join also covers
    range joins by bins; off, these are nested loops."""

    planner: str = "baseline"
    index_join: bool = True
    sort_merge_join: bool = True
    hash_join: bool = True

    def hint(self, equi: bool) -> str | None:
        if self.index_join and self.sort_merge_join and self.hash_join:
            return None
        if equi:
            # an index join here is a join that needs no index: the optimizer's own choice
            return None if self.index_join else "merge" if self.sort_merge_join else "shuffle_hash" if self.hash_join else "shuffle_replicate_nl"
        return None


def joined(block: Block, options: Options) -> tuple[DataFrame, R.Known]:
    (alias, table), *others = block.tables
    pending = conjuncts(block.where)
    df, known = R.scan(alias, table, [c for c in pending if c.tables == {alias}] if options.planner != "naive" else [])
    if options.planner == "naive":
        for alias, table in others:
            right, more = R.scan(alias, table)
            df, known = df.crossJoin(right), known | more
        return R.select_rows(df, block.where, known), known
    seen = {alias}
    first = [c for c in pending if c.tables <= seen]
    for c in first:
        df = R.select_rows(df, c, known)
    pending = [c for c in pending if not c.tables <= seen]
    for alias, table in others:
        own = [c for c in pending if c.tables == {alias}]
        right, more = R.scan(alias, table, own)
        known = known | more
        for c in own:
            right = R.select_rows(right, c, known)
        now = [c for c in pending if c.tables <= seen | {alias} and c not in own]
        equi = any(R.equi(c, seen, alias) for c in now)
        if options.index_join and not equi and (bounds := R.between(now, seen, alias)):
            df = R.range_join(df, right, now, known, bounds)
        else:
            df = R.join(df, right, now, known, options.hint(equi))
        seen.add(alias)
        pending = [c for c in pending if not c.tables <= seen]
    return df, known


def plan(block: Block, options: Options | None = None) -> DataFrame:
    df, known = joined(block, options or Options())
    if block.group is not None:
        exprs = [*(e for e, _ in block.items), *([block.having] if block.having else []), *(e for e, _ in block.order)]
        aggregates = list(dict.fromkeys(x for e in exprs for x in e.walk() if x.op.startswith("agg:")))
        df, known = R.group(df, list(dict.fromkeys(block.group)), aggregates, known)
        df = R.select_rows(df, block.having, known)
    items: list[tuple[Expr, str]] = [(e, f"out{i}") for i, (e, _) in enumerate(block.items)]
    place = {e: n for e, n in items}
    extra = {e: f"sort{i}" for i, (e, _) in enumerate(block.order) if e not in place and not block.distinct}
    df = R.project(df, [*items, *extra.items()], known)
    if block.distinct:
        df = df.distinct()
    if block.order:
        df = R.sort(df, [(F.col((place | extra)[e]), up) for e, up in block.order])
    if block.offset is not None:
        df = df.offset(block.offset)
    if block.limit is not None:
        df = df.limit(block.limit)
    return df.select(*[F.col(n).alias(name) for (_, n), (_, name) in zip(items, block.items, strict=True)])
