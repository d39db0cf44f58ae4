"""Summaries and plot data for people; every table they show is a small aggregate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fmt_ns
from ..operators import activity as A
from ..operators import flame as FL
from ..operators import hotspots as H
from ..operators import roofline as R


def summary(spans: DataFrame, counters: DataFrame | None = None, top: int = 20, exact: bool = False) -> str:
    """Counters, categories, hotspots and GPU stalls as text.

    Columns widen for what is longer than they are; with ``exact`` those of the categories keep their width, as SQL's lpad and rpad do.
    """
    cell = lambda x, width, side: f"{x:{side}{width}}"[: width if exact else None]
    out = []
    if counters is not None:
        out.append("Counters")
        out += [f"  {r.name:<40} {r.value:>16,.2f}" for r in A.last_values(counters).orderBy("name").collect()]
    out.append("Categories")
    out += [f"  {cell(r.category, 12, '<')} {cell(format(r['count'], ','), 10, '>')} {cell(r.t, 12, '>')}" for r in H.by_category(spans).orderBy(F.desc("total_ns")).select("category", "count", fmt_ns(F.col("total_ns")).alias("t")).collect()]
    out.append(f"Hotspots (top {top})")
    rows = H.sorted_hotspots(spans, n=top).select("name", "category", "count", fmt_ns(F.col("total_ns")).alias("t"), fmt_ns(F.col("avg_ns")).alias("a"), "pct")
    out += [f"  {r.name[:42]:<42} {r.category:<8} {r['count']:>8,} {r.t:>10} {r.a:>10} {r.pct:>5.1f}%" for r in rows.collect()]
    g = A.gpu_starvation(spans).first()
    if g.gpu_active_ns:
        out += ["GPU", f"  active {g.gpu_active_pct:.1f}%, stalled {g.sync_stall_pct:.1f}% in {g.sync_calls} calls, idle {g.launch_gap_pct:.1f}%"]
        if g.advice != "none":
            out.append("  much time in synchronisation" if g.advice == "sync" else "  the GPU waits for launches")
    return "\n".join(out)


def flame_json(folded: DataFrame, least_pct: float = 0.02, most: int = 2000) -> str:
    """A flame graph as nested JSON (name, value, children) of a bounded number of frames."""
    root: dict = {"name": "all", "value": 0, "children": []}
    at: dict[tuple, dict] = {(): root}
    for r in FL.icicle(FL.tree(folded), least_pct, most).collect():
        node = {"name": r["name"], "value": r["value"], "children": []}
        at[tuple(r["path"])] = node
        parent = at.get(tuple(r["path"][:-1]))
        if parent is not None:
            parent["children"].append(node)
    root["value"] = sum(c["value"] for c in root["children"])
    return json.dumps(root)


def write_folded(folded: DataFrame, path: str) -> None:
    folded.select(F.concat_ws(" ", "stack", F.col("count").cast("string")).alias("value")).write.mode("overwrite").text(path)


def roofline_json(metrics: DataFrame, device: DataFrame) -> str:
    """Lines, points and axes of a roofline plot."""
    axes = R.axis_ranges(metrics, device).first().asDict()
    lines = [r.asDict() for r in R.ceilings(device, metrics if "occupancy_pct" in metrics.columns else None).collect()]
    points = [r.asDict() for r in R.points(metrics, device).orderBy("kernel").collect()]
    return json.dumps({"axes": axes, "lines": lines, "points": points})
