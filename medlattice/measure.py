"""What a query did: wall time, rows and bytes that its scans read, bytes shuffled and spilled, and its physical plan, from Spark's own metrics."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
#: Metric of a plan's node -> what it counts towards, for nodes whose name begins so.
_WANTED = {("Scan", "number of output rows"): "rows_read", ("Scan", "size of files read"): "bytes_read", ("Exchange", "shuffle bytes written"): "bytes_shuffled", ("", "spill size"): "bytes_spilled"}


def _number(text: str) -> float:
    """The total of a metric as Spark shows it: `1,234`, `12.3 MiB`, or a line with the total below a heading."""
    m = re.match(r"([\d,.]+)\s*([KMGT]?i?B)?", text.split("\n")[-1].strip())
    return float(m[1].replace(",", "")) * _UNITS.get(m[2] or "B", 1) if m else 0.0


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _last(store) -> int:
    held = store.executionsList()
    return held.last().executionId() if held.size() else -1


def _since(store, seen: int) -> list:
    """The executions after one, by their ids: the store forgets old ones, so their count says nothing."""
    held, out = store.executionsList(), []
    for i in range(held.size() - 1, -1, -1):
        e = held.apply(i)
        if e.executionId() <= seen:
            break
        out.append(e)
    return out[::-1]


def measured(spark: SparkSession, query: Callable[[], DataFrame]) -> dict:
    """Builds and runs a query, all of its rows thrown away. What it computes on the way (tables it writes, counts) is part of it."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = _last(store)
    began = time.perf_counter()
    query().write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    out: dict = {"seconds": round(took, 3), "jobs": 0, **dict.fromkeys(_WANTED.values(), 0)}
    plan = ""
    for e in _since(store, seen):
        out["jobs"] += 1
        values = store.executionMetrics(e.executionId())
        plan = e.physicalPlanDescription()
        for node in _items(store.planGraph(e.executionId()).allNodes()):
            for m in _items(node.metrics()):
                kind = next((v for (name, metric), v in _WANTED.items() if node.name().startswith(name) and m.name() == metric), None)
                said = values.get(m.accumulatorId())
                if kind and said.isDefined():
                    out[kind] += round(_number(said.get()))
    out["plan"] = sorted(set(re.findall(r"(?m)^[\s+|:\-*]*(?:\(\d+\) |\* )?([A-Z]\w+)", plan.split("\n\n")[0])) - {"Physical", "AdaptiveSparkPlan"})
    return out
