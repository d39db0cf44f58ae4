"""Logical tables of a trace, as Spark DDL, and the vocabulary of categories.

Timestamps and durations are nanoseconds in BIGINT columns: Spark's timestamp
type stops at microseconds.  ``seq`` is arrival order; wherever "the first" or
"the last" of something is asked for, it decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = (
    "trace_id STRING, seq BIGINT, name STRING, category STRING, start_ns BIGINT, duration_ns BIGINT, end_ns BIGINT, "
    "pid BIGINT, tid BIGINT, tags MAP<STRING,STRING>, stack_frames ARRAY<STRING>, span_id STRING, parent_span_id STRING"
)
INSTANTS = "trace_id STRING, seq BIGINT, name STRING, category STRING, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, tags MAP<STRING,STRING>"
COUNTERS = "trace_id STRING, seq BIGINT, name STRING, category STRING, timestamp_ns BIGINT, value DOUBLE, unit STRING, pid BIGINT"
PC_SAMPLES = "trace_id STRING, func_name STRING, pc_offset BIGINT, stall_reason INT, count BIGINT"
DEVICES = (
    "trace_id STRING, device_idx INT, name STRING, backend STRING, fp32_tflops DOUBLE, fp64_tflops DOUBLE, fp16_tflops DOUBLE, "
    "bandwidth_gbs DOUBLE, sm_count INT, core_clock_ghz DOUBLE, mem_clock_ghz DOUBLE, mem_bus_bits INT, vram_gb DOUBLE, compute_cap STRING, "
    "tensor_tflops DOUBLE, l2_bandwidth_gbs DOUBLE, l1_bandwidth_gbs DOUBLE, l3_bandwidth_gbs DOUBLE"
)
DISASM_LINES = (
    "kernel STRING, arch STRING, pos INT, addr BIGINT, mnemonic STRING, operands STRING, itype STRING, comment STRING, raw STRING, "
    "source_file STRING, source_line INT, sample_pct DOUBLE, stall_cycles INT, stall_reason STRING"
)
KERNEL_COUNTERS = (
    "kernel_name STRING, fp32_ops DOUBLE, fp64_ops DOUBLE, fp16_ops DOUBLE, dram_bytes DOUBLE, l2_bytes DOUBLE, l1_bytes DOUBLE, "
    "duration_ns BIGINT, sm_cycles_elapsed DOUBLE, sm_cycles_max DOUBLE, source STRING, l3_bytes DOUBLE, occupancy_pct DOUBLE, ipc DOUBLE"
)
META = "trace_id STRING, command STRING, args ARRAY<STRING>, start_time_ns BIGINT, end_time_ns BIGINT, pid BIGINT, backends ARRAY<STRING>, hostname STRING, cwd STRING, duration_ms DOUBLE"

# The categories of records.
CATEGORIES = ["cpu", "cuda", "rocm", "opencl", "openmp", "mpi", "nccl", "memory", "sync", "jit", "nvtx", "other"]
# Categories that run on a GPU, and synchronising calls that count as stalls.
GPU_CATEGORIES = ["cuda", "rocm", "opencl"]
GPU_TIMELINE = ["cuda", "rocm"]
SYNC_NAMES = [
    "cudaDeviceSynchronize", "cudaStreamSynchronize", "cudaEventSynchronize",
    "hipDeviceSynchronize", "hipStreamSynchronize", "hipEventSynchronize", "clFinish", "clWaitForEvents",
]


def category(c: Column) -> Column:
    """A category, ``other`` if it is none of the known ones."""
    return F.when(c.isin(CATEGORIES), c).otherwise(F.lit("other"))


def empty_tags() -> Column:
    return F.create_map().cast("map<string,string>")
