"""How often each headline operator reads the sales table, and which columns.

    python scripts/plan_report.py [sf_dir]

Builds the sales table once (written to the checkpoint folder), executes each
operator's own physical plan, then walks the executed plan (query stages and
cached builds included) and sums the rows produced by every distinct parquet
scan of the sales table: rows read / table rows = passes over the data.
Also lists the pruned read schemas of the scans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from tillroll.session import get_spark  # noqa: E402
from tillroll.sources import fixtures  # noqa: E402
from tillroll.sources.tables import write_table  # noqa: E402

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
         "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "Window", "InMemoryTableScan", "FileScan"]


def _outside_cache(plan: str) -> str:
    """Drop the subtrees printed under InMemoryRelation (the cached source
    plans), keeping the nodes this query itself executes."""
    keep, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = None
        keep.append(line)
        if "InMemoryRelation" in line:
            skip = depth
    return "\n".join(keep)


def _children(node):
    name = node.getClass().getSimpleName()
    kids = []
    if name == "AdaptiveSparkPlanExec":
        kids.append(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        kids.append(node.plan())
    elif name == "InMemoryTableScanExec":
        kids.append(node.relation().cachedPlan())
    ch = node.children()
    kids += [ch.apply(i) for i in range(ch.size())]
    sub = node.subqueries()
    kids += [sub.apply(i) for i in range(sub.size())]
    return kids


def rows_scanned(df, table: str) -> int:
    """Rows read from ``table`` by every distinct parquet scan node that this
    query executed, cached builds included (each counted once)."""
    jvm = df.sparkSession._jvm
    seen, total = set(), 0
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        ident = jvm.System.identityHashCode(node)
        if ident in seen:
            continue
        seen.add(ident)
        if node.getClass().getSimpleName() == "FileSourceScanExec" and \
                table in node.relation().location().rootPaths().toString():
            total += node.metrics().apply("numOutputRows").value()
        stack.extend(_children(node))
    return total


def summary(df) -> dict:
    plan = _outside_cache(df._jdf.queryExecution().executedPlan().toString())
    out = {n: plan.count(n) for n in NODES}
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution()
                                  .explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))))
    out["read_schemas"] = scans
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 16)
    sales = write_table(fixtures.sales(spark, sf_dir), "plan_sales")
    n_lines = sales.count()
    for name, op in HEADLINE.items():
        spark.catalog.clearCache()
        df = op(sales)
        # run this DataFrame's own physical plan so its scan metrics fill in
        df._jdf.queryExecution().executedPlan().execute().count()
        s = summary(df)
        passes = rows_scanned(df, "plan_sales") / n_lines
        print(f"{name}: passes over the sales table = {passes:.2f}")
        for rs in s["read_schemas"]:
            print(f"    scan {rs}")
    spark.stop()


if __name__ == "__main__":
    main()
