"""A trace in a nutshell: everything a reader needs first, as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import activity as A
from . import hierarchy as T
from . import hotspots as H
from . import spans as S


def hardware(devices: DataFrame) -> DataFrame:
    """What there is of each device."""
    return devices.select(F.concat("backend", F.lit("_device")).alias("key"), "name", "fp32_tflops", "fp64_tflops", F.col("bandwidth_gbs").alias("peak_mem_bw_gbs"), F.when(F.col("fp16_tflops") != 0, F.col("fp16_tflops")).alias("fp16_tflops"), F.when(F.col("sm_count") != 0, F.col("sm_count")).alias("sm_count"))


def gpu_activity(spans: DataFrame, counters: DataFrame) -> DataFrame:
    """key, value: highest utilisation and memory of each GPU, and kernel time of each backend."""
    util = A.peaks(counters, "gpu_utilization_pct").select(F.concat(F.lit("gpu"), "label", F.lit("_util_pct")).alias("key"), F.col("peak").alias("value"))
    mem = A.peaks(counters, "gpu_mem_used_bytes").select(F.concat(F.lit("gpu"), "label", F.lit("_mem_used")).alias("key"), F.col("peak").alias("value"))
    active = A.kernel_active(spans).where("kernel_ns > 0").select(F.concat("category", F.lit("_kernel_active_pct")).alias("key"), F.col("active_pct").alias("value"))
    return util.unionByName(mem).unionByName(active)


def _packed(df: DataFrame, name: str, order: list) -> DataFrame:
    """All rows of a small result as one array of structs, in order."""
    less = lambda x, y: F.when(x["o_"] < y["o_"], -1).when(x["o_"] > y["o_"], 1).otherwise(0)
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o_"), F.struct(*df.columns).alias("v_"))), less)
    return df.agg(F.transform(rows, lambda x: x["v_"]).alias(name))


def profile(spans: DataFrame, counters: DataFrame | None = None, devices: DataFrame | None = None, hotspots: int = 15) -> DataFrame:
    """One row: the profile as JSON.  Every part is a small aggregate; nothing but one row reaches the driver."""
    run = H.parallelism(spans).select(F.struct("wall_ns", "total_spans", "thread_count", "aggregate_ns", "efficiency_pct").alias("run"))
    parts = [
        _packed(H.breakdown(spans), "time_breakdown_by_category", [(-F.col("total_ns")).alias("a"), F.col("category")]),
        _packed(H.context_hotspots(spans, hotspots), "top_hotspots", [(-F.col("total_ns")).alias("a"), F.col("category"), F.col("name")]),
        _packed(A.transfers(spans), "memory", [F.lit(0).alias("a")]),
        _packed(T.children_of(spans), "span_hierarchy_sample", [(-F.col("children_ns")).alias("a"), F.col("parent_span_id")]),
    ]
    if counters is not None:
        parts.append(_packed(gpu_activity(spans, counters), "gpu_activity", [F.col("key")]))
        parts.append(_packed(A.hardware_counters(counters), "hardware_counters", [F.col("name")]))
        rss = counters.where("name = 'process_max_rss_bytes'").agg(F.max("value").alias("process_peak_rss_bytes"))
        parts.append(rss)
    if devices is not None:
        parts.append(_packed(hardware(devices), "hardware", [F.col("key"), F.col("name")]))
    out = run
    for p in parts:
        out = out.crossJoin(p)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("profile"))


def wall_ns(spans: DataFrame) -> int:
    return S.wall(spans).first()["wall_ns"]
