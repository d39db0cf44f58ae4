"""Record lines as streams.

The parser is the batch one: its expressions know no difference.  Stacks are
attached to spans by a stream-stream join with watermarks, gauges are reduced
in tumbling windows, phases found by session windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import wire


def lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of lines of record files as they arrive."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select("value")


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, for demonstrations."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def event_time(ns: Column) -> Column:
    """A timestamp for watermarks; nanoseconds stay in their own column."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def spans(stream: DataFrame) -> DataFrame:
    return wire.spans(wire.parse(stream)).withColumn("event_time", event_time(F.col("start_ns")))


def stacks(stream: DataFrame) -> DataFrame:
    return wire.stacks(wire.parse(stream)).withColumn("event_time", event_time(F.col("start_ns")))


def counters(stream: DataFrame) -> DataFrame:
    return wire.counters(wire.parse(stream)).withColumn("event_time", event_time(F.col("timestamp_ns")))


def attach(spans_: DataFrame, stacks_: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Spans with the stacks of their thread and start, in whichever order they arrive; state ends with the watermark."""
    a = spans_.withWatermark("event_time", late)
    b = stacks_.withWatermark("event_time", late).select(*[F.col(c).alias(f"k_{c}") for c in ("pid", "tid", "start_ns", "frames", "event_time")])
    on = (F.col("pid") == F.col("k_pid")) & (F.col("tid") == F.col("k_tid")) & (F.col("start_ns") == F.col("k_start_ns")) & (F.col("event_time") == F.col("k_event_time"))
    return a.join(b, on, "left_outer").withColumn("stack_frames", F.coalesce("k_frames", F.array().cast("array<string>"))).drop("k_pid", "k_tid", "k_start_ns", "k_frames", "k_event_time")


def gauges(counters_: DataFrame, window: str = "1 second", late: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Highest and mean value of each counter in windows of time."""
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    by = counters_.withWatermark("event_time", late).groupBy(span.alias("w"), "name")
    return by.agg(F.max("value").alias("peak"), F.avg("value").alias("mean"), F.count("*").alias("points")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "name", "peak", "mean", "points")


def phases(spans_: DataFrame, gap: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Stretches of activity of each category that no gap interrupts."""
    by = spans_.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "category")
    return by.agg(F.count("*").alias("spans"), F.sum("duration_ns").alias("total_ns")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "category", "spans", "total_ns")


def hotspots(spans_: DataFrame) -> DataFrame:
    """Running totals by category and name (update or complete mode)."""
    return spans_.groupBy("category", "name").agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.max("duration_ns").alias("max_ns"))


def on_batch(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Call back with each batch."""
    return df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)


def refreshed(stream: DataFrame, static: Callable[[], DataFrame], on: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """A stream joined to a table that is read anew for each batch, so that late additions to it are seen."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(df.join(static(), on, "left"), n)).option("checkpointLocation", checkpoint)


def append(df: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Write finished rows as Parquet, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
