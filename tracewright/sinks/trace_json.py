"""Trace documents.

``events`` makes a JSON row of each event; written as text they are JSON lines,
at any scale.  ``document`` assembles one file for viewers: events are written
by Spark, and only the concatenation runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours of categories in trace viewers.
COLOURS = {
    "cpu": "good", "cuda": "terrible", "rocm": "bad", "opencl": "yellow", "openmp": "olive", "memory": "grey", "sync": "white", "jit": "purple", "nvtx": "thread_state_usermode",
}
OTHER_COLOUR = "generic_work"


def colour(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[c], F.lit(OTHER_COLOUR))


def _json(*cols) -> Column:  # noqa: ANN002
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def span_events(spans: DataFrame) -> DataFrame:
    """order, json: complete events; stacks and span ids are kept among the arguments."""
    extra = F.map_filter(F.create_map(F.lit("_stack"), F.when(F.size("stack_frames") > 0, F.to_json("stack_frames")), F.lit("_sid"), F.col("span_id"), F.lit("_psid"), F.col("parent_span_id")), lambda k, v: v.isNotNull())
    args = F.map_concat(F.coalesce("tags", F.create_map().cast("map<string,string>")), extra)
    row = _json(F.lit("X").alias("ph"), "name", F.col("category").alias("cat"), (F.col("start_ns") / 1000).alias("ts"), (F.col("duration_ns") / 1000).alias("dur"), "pid", "tid", colour(F.col("category")).alias("cname"), args.alias("args"))
    return spans.select(F.struct(F.lit(1).alias("k"), F.lit("").alias("n"), F.col("seq").alias("t"), F.col("seq").alias("s")).alias("order"), row.alias("json"))


def instant_events(instants: DataFrame) -> DataFrame:
    row = _json(F.lit("i").alias("ph"), "name", F.col("category").alias("cat"), (F.col("timestamp_ns") / 1000).alias("ts"), "pid", "tid", F.lit("t").alias("s"))
    return instants.select(F.struct(F.lit(2).alias("k"), F.lit("").alias("n"), F.col("seq").alias("t"), F.col("seq").alias("s")).alias("order"), row.alias("json"))


def counter_events(counters: DataFrame) -> DataFrame:
    """Counter events, by name and then in order of time."""
    args = F.map_filter(F.create_map(F.col("name"), F.col("value").cast("string"), F.lit("_unit"), F.col("unit")), lambda k, v: v.isNotNull() & (v != ""))
    row = _json(F.lit("C").alias("ph"), "name", F.col("category").alias("cat"), (F.col("timestamp_ns") / 1000).alias("ts"), "pid", F.lit(0).alias("tid"), args.alias("args"))
    return counters.select(F.struct(F.lit(3).alias("k"), F.col("name").alias("n"), F.col("timestamp_ns").alias("t"), F.col("seq").alias("s")).alias("order"), row.alias("json"))


def events(spans: DataFrame, instants: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """order, json of all events."""
    out = span_events(spans)
    out = out.unionByName(instant_events(instants)) if instants is not None else out
    return out.unionByName(counter_events(counters)) if counters is not None else out


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in order, in as many files as there are ranges."""
    rows.orderBy("order").select("json").write.mode("overwrite").text(path)


def document(rows: DataFrame, metadata: dict | None = None, process: str = "profiled-process", pid: int = 0) -> str:
    """One document; rows come to the driver partition by partition."""
    import json

    head = json.dumps({"ph": "M", "pid": pid, "tid": 0, "name": "process_name", "args": {"name": process}})
    body = ",".join([head, *(r.json for r in rows.orderBy("order").select("json").toLocalIterator())])
    return f'{{"traceEvents":[{body}],"displayTimeUnit":"ms","metadata":{json.dumps(metadata or {})}}}'
