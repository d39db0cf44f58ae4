"""Memory, synchronisation, communication, counters, GPU activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import grade
from ..schema import GPU_CATEGORIES, SYNC_NAMES
from . import spans as S
from .intervals import unions
from .ranges import running


def _bandwidth(total_bytes: str = "total_bytes", total_ns: str = "total_ns"):  # noqa: ANN202
    """Bytes per nanosecond, which is GB/s."""
    return F.when((F.col(total_bytes) > 0) & (F.col(total_ns) > 0), F.col(total_bytes) / F.col(total_ns))


def memory_profile(spans: DataFrame, every_category: bool = False) -> DataFrame:
    """Memory operations by type; with ``every_category`` also copies that other categories recorded."""
    if every_category:
        rows = spans.where((F.col("category") == "memory") | F.coalesce(S.tag("type"), F.lit("")).isin("memcpy", "memcpy_async", "HtoD", "DtoH"))
    else:
        rows = spans.where("category = 'memory'")
    by = rows.groupBy(F.coalesce(S.tag("type"), F.col("name")).alias("operation"))
    out = by.agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.sum(S.tag_bytes()).alias("total_bytes"))
    return out.withColumns({"avg_ns": F.col("total_ns") / F.col("count"), "bandwidth_gbs": _bandwidth()})


def transfers(spans: DataFrame) -> DataFrame:
    """All memory operations together."""
    out = spans.where("category = 'memory'").agg(F.count("*").alias("count"), F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("total_ns"), F.coalesce(F.sum(S.tag_bytes()), F.lit(0.0)).alias("total_bytes"))
    return out.withColumn("bandwidth_gbs", _bandwidth())


def sync_analysis(spans: DataFrame) -> DataFrame:
    """Synchronising calls by name: shares of wall time and of all synchronisation, and whom they wait for."""
    rows = S.with_parent(spans.select("seq", "name", "category", "duration_ns", "span_id", "parent_span_id", "pid", "tid")).where("category = 'sync'")
    by = rows.groupBy("name").agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.slice(F.array_sort(F.collect_set("parent_name")), 1, 3).alias("waiting_for"))
    every = F.col("every_")
    out = S.with_wall(S.with_sum(by, "total_ns").withColumn("pct_of_sync", F.when(every > 0, F.lit(100.0) * F.col("total_ns") / every)).drop("every_"), spans)
    return out.withColumn("pct_wall", F.lit(100.0) * F.col("total_ns") / F.col("wall_ns")).drop("wall_ns")


def mpi_communication(spans: DataFrame) -> DataFrame:
    """MPI calls by operation, their bytes, and whether any is linked to a request."""
    rows = spans.where("category = 'mpi'")
    linked = F.bool_or(F.coalesce("parent_span_id", F.lit("")) != "").alias("linked")
    by = rows.groupBy("name").agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.sum(S.tag_bytes()).alias("total_bytes"), linked)
    return S.with_wall(by, spans).withColumn("pct_wall", F.lit(100.0) * F.col("total_ns") / F.col("wall_ns")).drop("wall_ns")


def request_pairs(spans: DataFrame) -> DataFrame:
    """How many requests begun by an isend are waited for."""
    mpi = spans.where("category = 'mpi'")
    begun = mpi.where(F.lower("name").contains("isend") & (F.coalesce("span_id", F.lit("")) != "")).select("span_id").distinct()
    waited = mpi.where(F.coalesce("parent_span_id", F.lit("")) != "").select(F.col("parent_span_id").alias("span_id"))
    return begun.join(waited, "span_id", "left_semi").agg(F.count("*").alias("linked_pairs"))


# ------------------------------------------------------------------ counters


def last_values(counters: DataFrame) -> DataFrame:
    """The latest value of each counter."""
    return counters.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def peaks(counters: DataFrame, prefix: str) -> DataFrame:
    """The highest value of each labelled counter (``prefix[label]``; label 0 where there is none)."""
    rows = counters.where(F.col("name").startswith(prefix))
    label = F.regexp_extract("name", r"\[(?:gpu)?([^\]]*)\]", 1)
    return rows.groupBy(F.when(label == "", "0").otherwise(label).alias("label")).agg(F.max("value").alias("peak"))


def series(counters: DataFrame) -> DataFrame:
    """Points of each counter in order of time."""
    rows = counters.select("name", "timestamp_ns", "seq", "value")
    return running(rows, ["name"], ["timestamp_ns", "seq"], {"pos": ("sum", F.lit(1))}).select("name", F.col("pos").cast("int").alias("pos"), "timestamp_ns", "value")


def hardware_counters(counters: DataFrame) -> DataFrame:
    """The latest values of processor counters."""
    wanted = ["ipc", "cache_miss_pct", "branch_miss_pct", "dram_bw_gbs", "l3_bw_gbs", "flops_sp", "flops_dp"]
    return last_values(counters.where(F.col("name").isin(wanted)))


# ------------------------------------------------------------------ GPU activity


def is_kernel():  # noqa: ANN201
    """GPU work: kernels, and spans of GPU categories that aren't marked as host side."""
    side = S.tag("side")
    return F.col("category").isin(GPU_CATEGORIES) & (F.coalesce(S.tag("type") == "kernel", F.lit(False)) | side.isNull() | (side == "gpu"))


def kernel_active(spans: DataFrame) -> DataFrame:
    """Summed kernel time by backend, as a share of the wall time (overlaps count twice)."""
    rows = spans.where(F.col("category").isin("cuda", "rocm") & (S.tag("type") == "kernel")).groupBy("category").agg(F.sum("duration_ns").alias("kernel_ns"))
    return S.with_wall(rows, spans).select("category", "kernel_ns", (F.lit(100.0) * F.col("kernel_ns") / F.col("wall_ns")).alias("active_pct"))


def gpu_efficiency(spans: DataFrame) -> DataFrame:
    """Kernel time against kernel and synchronisation time, with a grade."""
    out = spans.agg(
        F.coalesce(F.sum(F.when(F.col("category").isin("cuda", "rocm") & (S.tag("type") == "kernel"), F.col("duration_ns"))), F.lit(0)).alias("active_ns"),
        F.coalesce(F.sum(F.when(F.col("category") == "sync", F.col("duration_ns"))), F.lit(0)).alias("sync_ns"),
    )
    pct = F.when(F.col("active_ns") + F.col("sync_ns") > 0, F.lit(100.0) * F.col("active_ns") / (F.col("active_ns") + F.col("sync_ns"))).otherwise(0.0)
    return out.withColumn("efficiency_pct", pct).withColumn("grade", grade(F.col("efficiency_pct")))


def gpu_starvation(spans: DataFrame) -> DataFrame:
    """Wall time, time with any GPU work (a true union), stalls in synchronisation, and the gap that is left.

    ``launch_gap_ns`` takes both off the wall time although they may overlap;
    ``gap_exact_ns`` takes off their union.
    """
    stall = F.coalesce(F.col("name").isin(SYNC_NAMES) & (F.col("duration_ns") > 0), F.lit(False))
    busy = spans.where(is_kernel() | stall)
    both = unions(busy, {"gpu_active_ns": is_kernel(), "busy_ns": F.lit(True)})
    sync = spans.agg(F.coalesce(F.sum(F.when(stall, F.col("duration_ns"))), F.lit(0)).alias("sync_stall_ns"), F.count_if(stall).alias("sync_calls"))
    one = S.wall(spans).select("wall_ns").crossJoin(both).crossJoin(sync)
    pct = lambda c: F.lit(100.0) * F.col(c) / F.col("wall_ns")
    out = one.withColumns({"launch_gap_ns": F.greatest(F.lit(0), F.col("wall_ns") - F.col("gpu_active_ns") - F.col("sync_stall_ns")), "gap_exact_ns": F.col("wall_ns") - F.col("busy_ns")})
    out = out.withColumns({"gpu_active_pct": pct("gpu_active_ns"), "sync_stall_pct": pct("sync_stall_ns"), "launch_gap_pct": pct("launch_gap_ns")})
    advice = F.when(F.col("sync_stall_pct") > 20, "sync").when(F.col("launch_gap_pct") > 30, "launch_gap").otherwise("none")
    return out.drop("busy_ns").withColumn("advice", advice)
