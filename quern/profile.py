"""Per-operator profiles: the metrics that Spark keeps for each operator of a plan it has run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _inner(node) -> list:
    """A node's inputs; adaptive plans and their stages are looked into, as they hide what ran."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    return _listed(node.children())


def measured(df: DataFrame) -> list[tuple[int, str, dict[str, int]]]:
    """Run df to its end and return (depth, operator, metrics) from the root down."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out: list[tuple[int, str, dict[str, int]]] = []

    def walk(node, depth: int) -> None:
        metrics, names = node.metrics(), node.metrics().keys().iterator()
        found = {}
        while names.hasNext():
            k = names.next()
            found[k] = metrics.apply(k).value()
        out.append((depth, node.nodeName(), {k: v for k, v in sorted(found.items()) if v > 0}))
        for child in _inner(node):
            walk(child, depth + 1)

    walk(execution.executedPlan(), 0)
    return out
