"""A report in Markdown: what a trace shows, in tables that are small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fmt_ns
from ..operators import activity as A
from ..operators import hotspots as H


def _table(heads: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return [line(heads), "|" + "---|" * len(heads), *map(line, rows), ""]


def sections(spans: DataFrame, top: int = 20) -> list[tuple[str, list[str], DataFrame]]:
    """Title, heads and rows (text, in order) of each table."""
    time = lambda c: fmt_ns(F.col(c)).alias(c)
    pct = lambda c: F.format_string("%.1f %%", F.col(c)).alias(c)
    n = F.col("count").cast("string").alias("count")
    return [
        ("Run", ["Spans", "Threads", "Wall time"], H.parallelism(spans).select(F.col("total_spans").cast("string").alias("total_spans"), F.col("thread_count").cast("string").alias("thread_count"), time("wall_ns"))),
        ("Categories", ["Category", "Count", "Time"], H.by_category(spans).orderBy(F.desc("total_ns"), "category").select("category", n, time("total_ns"))),
        ("Hotspots", ["Name", "Category", "Count", "Time", "Mean", "Share"], H.sorted_hotspots(spans, n=top).select("name", "category", n, time("total_ns"), time("avg_ns"), pct("pct"))),
        ("Synchronisation", ["Name", "Count", "Time", "Of all synchronisation"], A.sync_analysis(spans).orderBy(F.desc("total_ns"), "name").select("name", n, time("total_ns"), pct("pct_of_sync"))),
        ("GPU", ["Active", "Stalled", "Gap"], A.gpu_starvation(spans).where("gpu_active_ns > 0").select(pct("gpu_active_pct"), pct("sync_stall_pct"), pct("launch_gap_pct"))),
    ]


def markdown(spans: DataFrame, title: str = "Performance report", notes: str = "", about: dict[str, str] | None = None, top: int = 20) -> str:
    """The whole report; ``about`` are lines on the run, ``notes`` any findings in Markdown."""
    out = [f"# {title}", "", *[f"**{k}:** {v}  " for k, v in (about or {}).items()], ""]
    for name, heads, rows in sections(spans, top):
        body = [list(r) for r in rows.collect()]
        if body:
            out += [f"## {name}", "", *_table(heads, body)]
    if notes:
        out += ["## Findings", "", notes.rstrip(), ""]
    return "\n".join(out)


def write(path: str, text: str, spans: DataFrame) -> None:
    """Put a report where Spark writes files."""
    spark = spans.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
