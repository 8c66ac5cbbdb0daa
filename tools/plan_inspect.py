"""Operator counts of an executed plan, for plan tests and reports.

Walks the physical plan (AQE final plans, query stages, subqueries) without
descending into cached relations, whose work was done once when they were
built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

KINDS = ["shuffle", "broadcast", "smj", "bhj", "nested_loop", "window", "sort", "top_k", "subquery", "scan"]


def execute(df: DataFrame) -> None:
    """Run the very plan that ``df`` holds, so that what is read from it afterwards is final."""
    df._jdf.queryExecution().toRdd().count()


def is_final(df: DataFrame) -> bool:
    """Whether the plan that ``df`` holds has run (a plan without adaptive parts is final as it stands)."""
    top = df._jdf.queryExecution().executedPlan().toString().partition("\n")[0]  # below: cached plans, subqueries
    return "isFinalPlan=false" not in top


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def walk(node, counts: dict, seen_subqueries: set) -> None:
    """Count the operators of one executed plan, not descending into cached
    relations (their work was done once, when the study was built)."""
    cls = node.getClass().getSimpleName()
    if cls == "AdaptiveSparkPlanExec":
        return walk(node.executedPlan(), counts, seen_subqueries)
    if cls in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"):
        if cls == "TableCacheQueryStageExec":
            return
        return walk(node.plan(), counts, seen_subqueries)
    if cls == "ReusedExchangeExec" or cls == "ReusedSubqueryExec":
        return
    if cls == "ShuffleExchangeExec":
        counts["shuffle"] += 1
    elif cls == "BroadcastExchangeExec":
        counts["broadcast"] += 1
    elif cls == "SortMergeJoinExec":
        counts["smj"] += 1
    elif cls == "BroadcastHashJoinExec":
        counts["bhj"] += 1
    elif cls in ("BroadcastNestedLoopJoinExec", "CartesianProductExec"):
        counts["nested_loop"] += 1
    elif cls == "WindowExec":
        counts["window"] += 1
    elif cls == "SortExec":
        counts["sort"] += 1
    elif cls == "TakeOrderedAndProjectExec":
        counts["top_k"] += 1
    elif cls in ("FileSourceScanExec",):
        counts["scan"] += 1
    elif cls == "InMemoryTableScanExec":
        return
    for sub in _seq(node.subqueries()):
        key = sub.toString()
        if key in seen_subqueries:
            continue
        seen_subqueries.add(key)
        counts["subquery"] += 1
        walk(sub, counts, seen_subqueries)
    for child in _seq(node.children()):
        walk(child, counts, seen_subqueries)


def operator_counts(df: DataFrame) -> dict[str, int]:
    """Run-independent counts for ``df``'s executed plan (execute it first to
    see AQE's final plan)."""
    counts = dict.fromkeys(KINDS, 0)
    walk(df._jdf.queryExecution().executedPlan(), counts, set())
    return counts


def read_schemas(df: DataFrame) -> list[str]:
    """``ReadSchema`` of every file scan in ``df``'s plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("ReadSchema: ", 1)[1].strip() for line in plan.splitlines() if "ReadSchema: " in line]
