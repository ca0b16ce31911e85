"""Executed plans as rows: what ran, what was exchanged, and how many rows came out of each node.

The plan is the one that ran, as changed by adaptive execution. A node that is used again counts once, where it stands first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMA = "id int, parent int, node string, detail string, is_exchange boolean, is_scan boolean, rows_out long"


def _inner(node):
    """Stands for what it wraps: the final plan, the plan of a stage."""
    while True:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        elif name.endswith("QueryStageExec"):
            node = node.plan()
        elif name in ("InputAdapter", "WholeStageCodegenExec", "ReusedExchangeExec", "AQEShuffleReadExec", "ResultQueryStageExec"):
            if name == "ReusedExchangeExec":
                return node
            node = node.children().head()
        else:
            return node


def plan_rows(df: DataFrame, run: bool = True) -> DataFrame:
    """The nodes of a query's plan, root first. With ``run`` the query is executed, and nodes have their numbers of rows."""
    executed = df._jdf.queryExecution()
    if run:
        executed.toRdd().count()
    rows, open_at = [], [(executed.executedPlan(), -1)]
    while open_at:
        node, parent = open_at.pop()
        node = _inner(node)
        name, metrics, i = node.nodeName(), node.metrics(), len(rows)
        out = metrics.get("numOutputRows") if run else None
        count = out.get().value() if out is not None and out.isDefined() else None
        rows.append((i, parent, name, node.simpleStringWithNodeId()[:400], name in ("Exchange", "BroadcastExchange"), name.startswith("Scan") or name == "BatchScan", count))
        children = node.children()
        open_at += [(children.apply(k), i) for k in reversed(range(children.size()))]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def summary(df: DataFrame, run: bool = False) -> dict[str, int]:
    """How many shuffles, broadcasts and scans a plan has, and, if it ran, the rows that it scanned."""
    rows = plan_rows(df, run).collect()
    shuffles = sum(r.node == "Exchange" for r in rows)
    return {"shuffles": shuffles, "broadcasts": sum(r.node == "BroadcastExchange" for r in rows), "scans": sum(r.is_scan for r in rows), **({"scanned": sum(r.rows_out or 0 for r in rows if r.is_scan)} if run else {})}
