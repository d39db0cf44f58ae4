"""Named analyses for interactive use: a registry of functions over a trace, with JSON answers.

``register`` adds one; ``execute`` runs it and wraps what goes wrong - an unknown
name, a wrong argument - in an ``error`` document.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity, hotspots, intervals, spans


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    description: str

    @property
    def parameters(self) -> list[str]:
        return [p for p in inspect.signature(self.run).parameters][1:]


REGISTRY: dict[str, Tool] = {}


def register(name: str, run: Callable[..., DataFrame], description: str = "") -> None:
    """Make ``run(spans, **arguments)`` known as ``name``."""
    REGISTRY[name] = Tool(name, run, description or (inspect.getdoc(run) or "").split("\n")[0])


register("get_hotspots", lambda df, n=10, category=None, min_duration_ms=None: hotspots.top_hotspots(df, n, category, min_duration_ms), "the heaviest names")
register("get_kernel_details", lambda df, name="": hotspots.kernel_details(df, name), "statistics of the spans whose name holds a text")
register("get_memory_profile", lambda df: activity.memory_profile(df).orderBy(F.desc("total_ns"), "operation"), "memory operations by type")
register("get_timeline_phases", lambda df, bucket_ms=0.0: intervals.timeline_phases(df, bucket_ms).orderBy("bucket", F.desc("busy_ns"), "category"), "activity by bucket of time")
register("get_sync_analysis", lambda df: activity.sync_analysis(df).orderBy(F.desc("total_ns"), "name"), "time in synchronisation")
register("get_mpi_communication", lambda df: activity.mpi_communication(df).orderBy(F.desc("total_ns"), "name"), "communication by operation")
register(
    "query_spans",
    lambda df, category=None, name_contains=None, min_duration_ms=None, max_duration_ms=None, sort_by="duration", limit=20, include_tags=True: spans.query(
        df, category, name_contains, min_duration_ms, max_duration_ms, sort_by, limit, include_tags
    ),
    "spans by filters",
)


def schema() -> list[dict]:
    """Names, descriptions and parameters of all tools."""
    return [{"name": t.name, "description": t.description, "parameters": t.parameters} for t in REGISTRY.values()]


def execute(trace: DataFrame, name: str, arguments: dict | None = None, most: int = 1000) -> str:
    """The tool's rows as JSON, at most ``most``."""
    if name not in REGISTRY:
        return json.dumps({"error": f"Unknown tool: {name}"})
    try:
        rows = REGISTRY[name].run(trace, **(arguments or {}))
        return json.dumps([json.loads(x) for x in rows.toJSON().take(most)], indent=2)
    except TypeError as e:
        return json.dumps({"error": f"Bad arguments for {name}: {e}"})
