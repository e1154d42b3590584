"""What a query will do, and what it did."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame

_NODES = re.compile(
    r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|BroadcastExchange|ReusedExchange|Exchange|HashAggregate|ObjectHashAggregate|SortAggregate|TakeOrderedAndProject|Window|Sort|Scan \w+|Generate|ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroupsInArrow)\b"
)


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_summary(df: DataFrame) -> dict:
    """Counts of the physical plan's operators, kinds of joins, filters that reached the scans and columns that they read."""
    plan = physical(df)
    nodes: dict[str, int] = {}
    for name in _NODES.findall(plan):
        nodes[name] = nodes.get(name, 0) + 1
    return {
        "nodes": nodes,
        "joins": re.findall(r"(?:Hash|Merge|NestedLoop)Join.*?(LeftSemi|LeftAnti|Inner|LeftOuter|RightOuter|FullOuter|Cross)", plan),
        "pushed": re.findall(r"PushedFilters: \[(.*?)\]", plan),
        "read": re.findall(r"ReadSchema: struct<(.*?)>", plan),
        "adaptive": "AdaptiveSparkPlan" in plan,
        "final": "isFinalPlan=true" in plan,
    }


def run_metrics(df: DataFrame) -> dict:
    """Seconds and rows of a full run without output, and the plan that adaptive execution ended with."""
    execution = df._jdf.queryExecution()  # the one whose plan ``plan_summary`` reads
    began = time.perf_counter()
    rows = execution.toRdd().count()
    return {"seconds": time.perf_counter() - began, "rows": rows, "plan": plan_summary(df), "columns": df.columns}


def diff_plans(a: DataFrame, b: DataFrame) -> dict[str, tuple[int, int]]:
    """Operators that two queries' plans use differently often."""
    x, y = plan_summary(a)["nodes"], plan_summary(b)["nodes"]
    return {k: (x.get(k, 0), y.get(k, 0)) for k in sorted({*x, *y}) if x.get(k, 0) != y.get(k, 0)}


def planned_start(durations: dict[str, float], parents: dict[str, list[str]]) -> dict[str, tuple[float, float]]:
    """For each stage of a graph the latest start that still ends as early as can be when parents feed it while they run, and its end.

    A stage can't end before its last parent has; started late enough, it never waits. This is a planning aid only: Spark schedules its own stages.
    """
    out: dict[str, tuple[float, float]] = {}
    open_: set[str] = set()

    def plan(stage: str) -> tuple[float, float]:
        if stage in out:
            return out[stage]
        if stage in open_:
            raise ValueError(f"stage {stage} waits for itself")
        open_.add(stage)
        before = [plan(p) for p in parents.get(stage, [])]
        first = max((start for start, _ in before), default=0.0)
        last = max((end for _, end in before), default=0.0)
        end = max(last, first + durations[stage])
        out[stage] = end - durations[stage], end
        return out[stage]

    for stage in durations:
        plan(stage)
    return out
