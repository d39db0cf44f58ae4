"""Saved traces: JSON documents with traceEvents, metadata and disassembly.

A document is one value, read by one task.  Traces with an event on each line, as
writers of large ones make them, are read line by line instead (``read_lines``),
split as Spark likes; the functions below take either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import category, empty_tags

_DEVICE = "name STRING, backend STRING, fp32_tflops DOUBLE, fp64_tflops DOUBLE, fp16_tflops DOUBLE, bandwidth_gbs DOUBLE, sm_count INT, core_clock_ghz DOUBLE, mem_clock_ghz DOUBLE, mem_bus_bits INT, vram_gb DOUBLE, compute_cap STRING, tensor_tflops DOUBLE, l2_bandwidth_gbs DOUBLE, l1_bandwidth_gbs DOUBLE, l3_bandwidth_gbs DOUBLE"
_LINE = "addr BIGINT, mnemonic STRING, operands STRING, itype STRING, comment STRING, raw STRING"
EVENT = "ph STRING, name STRING, cat STRING, ts DOUBLE, dur DOUBLE, pid BIGINT, tid BIGINT, cname STRING, s STRING, args MAP<STRING,STRING>"
DOCUMENT = (
    f"traceEvents ARRAY<STRUCT<{EVENT}>>, displayTimeUnit STRING, "
    f"metadata STRUCT<command STRING, args ARRAY<STRING>, backends ARRAY<STRING>, hostname STRING, cwd STRING, duration_ms DOUBLE, devices ARRAY<STRUCT<{_DEVICE}>>>, "
    f"disasm MAP<STRING, STRUCT<arch STRING, source STRING, lines ARRAY<STRUCT<{_LINE}>>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, with an explicit schema: nothing is inferred."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("trace_id", F.input_file_name())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The events of traces that hold one event a line."""
    return event_lines(spark.read.text(path).select(F.input_file_name().alias("trace_id"), "value"))


def event_lines(lines: DataFrame) -> DataFrame:
    """trace_id, seq and fields of the events on ``lines`` (trace_id, value): objects with a comma or bracket before or behind them."""
    text = F.regexp_replace(F.trim("value"), r'^(\{\s*"traceEvents"\s*:)?\s*\[?\s*,?\s*', "")
    text = F.regexp_replace(text, r'(,|\}\s*\]\s*(,\s*"displayTimeUnit".*|\}?))\s*$', "")
    # what closes the document went with the last event's own bracket
    whole = F.when(F.trim("value").rlike(r'\}\s*\]\s*(,\s*"displayTimeUnit".*|\}?)\s*$'), F.concat(text, F.lit("}"))).otherwise(text)
    rows = lines.select("trace_id", F.from_json(whole, EVENT).alias("e"), F.monotonically_increasing_id().alias("seq")).where("e.ph is not null")
    return rows.select("trace_id", "seq", "e.*")


def documents(texts: DataFrame) -> DataFrame:
    """Documents given as text (trace_id, value)."""
    return texts.select("trace_id", F.from_json("value", DOCUMENT).alias("d")).select("trace_id", "d.*")


def _events(doc: DataFrame) -> DataFrame:
    if "ph" in doc.columns:
        return doc
    return doc.select("trace_id", F.posexplode("traceEvents").alias("seq", "e")).select("trace_id", F.col("seq").cast("bigint").alias("seq"), "e.*")


def _ns(c: str):  # noqa: ANN202
    """Microseconds as whole nanoseconds, cut as integers are."""
    return (F.coalesce(F.col(c), F.lit(0.0)) * 1000).cast("bigint")


def spans(doc: DataFrame) -> DataFrame:
    e = _events(doc).where("ph = 'X'")
    tags = F.coalesce("args", empty_tags())
    frames = F.coalesce(F.from_json(F.col("args")["_stack"], "array<string>"), F.array().cast("array<string>"))
    start, length = _ns("ts"), _ns("dur")
    return e.select(
        "trace_id", "seq", "name", category(F.col("cat")).alias("category"), start.alias("start_ns"), length.alias("duration_ns"), (start + length).alias("end_ns"), F.coalesce("pid", F.lit(0)).alias("pid"), F.coalesce("tid", F.lit(0)).alias("tid"),
        F.map_filter(tags, lambda k, v: ~k.isin("_stack", "_sid", "_psid")).alias("tags"), frames.alias("stack_frames"), F.col("args")["_sid"].alias("span_id"), F.col("args")["_psid"].alias("parent_span_id"),
    )


def instants(doc: DataFrame) -> DataFrame:
    return _events(doc).where("ph = 'i'").select("trace_id", "seq", "name", category(F.col("cat")).alias("category"), _ns("ts").alias("timestamp_ns"), "pid", "tid", F.coalesce("args", empty_tags()).alias("tags"))


def counters(doc: DataFrame) -> DataFrame:
    """Counters; the value is the argument of the counter's own name, else the first one, else 0."""
    value = F.coalesce(F.col("args")[F.col("name")], F.try_element_at(F.map_values(F.map_filter("args", lambda k, v: k != "_unit")), F.lit(1))).try_cast("double")
    return _events(doc).where("ph = 'C'").select("trace_id", "seq", "name", category(F.col("cat")).alias("category"), _ns("ts").alias("timestamp_ns"), F.coalesce(value, F.lit(0.0)).alias("value"), F.coalesce(F.col("args")["_unit"], F.lit("")).alias("unit"), "pid")


def meta(doc: DataFrame) -> DataFrame:
    return doc.select("trace_id", "metadata.command", "metadata.args", "metadata.backends", "metadata.hostname", "metadata.cwd", "metadata.duration_ms")


def devices(doc: DataFrame) -> DataFrame:
    return doc.select("trace_id", F.posexplode("metadata.devices").alias("device_idx", "d")).select("trace_id", "device_idx", "d.*")


def disasm_lines(doc: DataFrame) -> DataFrame:
    k = doc.where("disasm is not null").select("trace_id", F.explode("disasm").alias("kernel", "k"))
    rows = k.select("trace_id", "kernel", F.col("k.arch").alias("arch"), F.col("k.source").alias("source"), F.posexplode("k.lines").alias("pos", "l"))
    return rows.select("trace_id", "kernel", "arch", "source", "pos", "l.*")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    doc = read(spark, path)
    return {"meta": meta(doc), "spans": spans(doc), "instants": instants(doc), "counters": counters(doc), "devices": devices(doc), "disasm_lines": disasm_lines(doc)}
