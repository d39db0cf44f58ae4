"""Device peaks, counter and static rooflines, plot geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.classify import ARCH
from .joins import device_of, kernel_binding

# By compute capability, CUDA cores per multiprocessor, FP64 share, L2 GB/s.
CORES = {"3.0": 192, "3.5": 192, "3.7": 192, "5.0": 128, "5.2": 128, "6.0": 64, "6.1": 128, "6.2": 128, "7.0": 64, "7.5": 64, "8.0": 64, "8.6": 128, "8.7": 128, "8.9": 128, "9.0": 128}
FP64 = {"7.0": 1 / 2, "7.5": 1 / 32, "8.0": 1 / 2, "8.6": 1 / 64, "8.7": 1 / 64, "8.9": 1 / 64, "9.0": 1 / 2}
L2 = {"6.0": 2000.0, "6.1": 400.0, "7.0": 3072.0, "7.5": 1700.0, "8.0": 6144.0, "8.6": 1560.0, "8.9": 2400.0, "9.0": 12288.0}
GFX_L2 = {"gfx908": 1600.0, "gfx90a": 6400.0, "gfx940": 6400.0, "gfx941": 6400.0, "gfx942": 6400.0, "gfx1030": 860.0, "gfx1100": 1920.0, "gfx1101": 960.0}
GFX_WIDE = ["gfx90a", "gfx940", "gfx941", "gfx942"]
# FLOPs of an instruction, by architecture and class; classes that aren't named have none.
FLOPS = {
    "x86": {"vec_sp": 16.0, "vec_dp": 8.0, "vector": 16.0, "compute": 2.0, "scalar": 0.5},
    "sass": {"compute": 2.0, "vector": 2.0, "vec_sp": 2.0, "vec_dp": 2.0, "scalar": 1.0},
    "ptx": {"compute": 2.0, "vector": 2.0, "vec_sp": 2.0, "vec_dp": 2.0, "scalar": 1.0},
    "amdgcn": {"vec_sp": 4.0, "vec_dp": 2.0, "vector": 4.0, "compute": 2.0, "scalar": 1.0},
    "aarch64": {"vec_sp": 8.0, "vec_dp": 4.0, "vector": 8.0, "compute": 2.0, "scalar": 0.5},
    "rv64": {"vec_sp": 4.0, "vec_dp": 2.0, "vector": 4.0, "compute": 2.0, "scalar": 0.5},
}
MEM_BYTES = {"rv64": 4.0}
LEFT, RIGHT, FLOOR = 1e-3, 1e5, 1e-3


def _dim(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _by_cc(table: dict, otherwise: Column) -> Column:
    """By compute capability, else by that of its major version, else a default."""
    cc = F.col("compute_cap")
    return F.coalesce(_dim(cc, table), _dim(F.concat(F.split_part(cc, F.lit("."), F.lit(1)), F.lit(".0")), table), otherwise)


def ridge(tflops: Column, gbs: Column) -> Column:
    return F.when(gbs > 0, tflops * 1e12 / (gbs * 1e9)).otherwise(F.lit(0.0))


def cuda_peaks(attributes: DataFrame) -> DataFrame:
    """Peaks of CUDA devices from sm_count, core_clock_ghz, mem_clock_ghz, mem_bus_bits, compute_cap."""
    major = F.split_part("compute_cap", F.lit("."), F.lit(1)).try_cast("int")
    out = attributes.withColumn("fp32_tflops", F.col("sm_count") * _by_cc(CORES, F.lit(64)) * 2 * F.col("core_clock_ghz") / 1000)
    out = out.withColumn("bandwidth_gbs", 2 * F.col("mem_clock_ghz") * F.col("mem_bus_bits") / 8)
    tensor = F.when(F.col("compute_cap") == "7.0", F.col("sm_count") * 8 * 64 * F.col("core_clock_ghz") / 1000).when(major >= 8, F.col("fp32_tflops") * 4).otherwise(0.0)
    return out.withColumns(
        {"fp64_tflops": F.col("fp32_tflops") * _by_cc(FP64, F.lit(1 / 32)), "fp16_tflops": F.col("fp32_tflops") * 2, "tensor_tflops": tensor, "l2_bandwidth_gbs": _by_cc(L2, 4 * F.col("bandwidth_gbs")), "ridge": ridge(F.col("fp32_tflops"), F.col("bandwidth_gbs"))}
    )


def rocm_peaks(attributes: DataFrame) -> DataFrame:
    """Peaks of ROCm devices; ``compute_cap`` holds the gfx name."""
    wide = F.col("compute_cap").isin(GFX_WIDE)
    out = attributes.withColumn("fp32_tflops", F.col("sm_count") * F.when(wide, 128).otherwise(64) * 2 * F.col("core_clock_ghz") / 1000)
    out = out.withColumn("bandwidth_gbs", 2 * F.col("mem_clock_ghz") * F.col("mem_bus_bits") / 8)
    return out.withColumns(
        {"fp64_tflops": F.col("fp32_tflops") * F.when(wide, 0.5).otherwise(1 / 16), "fp16_tflops": F.col("fp32_tflops") * 2, "l2_bandwidth_gbs": F.coalesce(_dim(F.col("compute_cap"), GFX_L2), 4 * F.col("bandwidth_gbs")), "ridge": ridge(F.col("fp32_tflops"), F.col("bandwidth_gbs"))}
    )


def cpu_peaks(attributes: DataFrame) -> DataFrame:
    """Peaks of CPUs from cores, core_clock_ghz (3 if unknown), flags and bandwidth_gbs (50 if unknown)."""
    flags = F.lower("flags")
    lanes = F.when(flags.contains("avx512f"), 16).when(flags.contains("avx"), 8).when(flags.contains("sse4"), 4).otherwise(1)
    out = attributes.withColumn("core_clock_ghz", F.coalesce("core_clock_ghz", F.lit(3.0))).withColumn("bandwidth_gbs", F.coalesce("bandwidth_gbs", F.lit(50.0)))
    out = out.withColumn("fp32_tflops", F.col("cores") * F.col("core_clock_ghz") * lanes * 2 / 1000)
    return out.withColumns({"fp64_tflops": F.col("fp32_tflops") / 2, "fp16_tflops": F.col("fp32_tflops"), "l3_bandwidth_gbs": F.col("bandwidth_gbs") * 4, "ridge": ridge(F.col("fp32_tflops"), F.col("bandwidth_gbs"))})


def from_counters(counters: DataFrame, device: DataFrame) -> DataFrame:
    """Roofline metrics of measured kernels on one device (a row of peaks)."""
    d = device.select(*[F.col(c).alias(f"d_{c}") for c in ("fp32_tflops", "fp64_tflops", "fp16_tflops", "bandwidth_gbs", "sm_count", "core_clock_ghz")])
    rows = counters.crossJoin(F.broadcast(d))
    clock = F.when(F.col("d_core_clock_ghz") > 0, F.col("d_core_clock_ghz") * 1e9).otherwise(F.lit(1e9))
    cycles = F.when(F.col("sm_cycles_max") > 0, (F.col("sm_cycles_max") / clock * 1e9).cast("bigint")).when(
        F.col("sm_cycles_elapsed") > 0, (F.col("sm_cycles_elapsed") / (F.when(F.col("d_sm_count") > 0, F.col("d_sm_count")).otherwise(1) * clock) * 1e9).cast("bigint")
    )
    rows = rows.withColumn("duration_ns", F.when(F.col("duration_ns") > 0, F.col("duration_ns")).otherwise(cycles)).where("duration_ns > 0")
    rows = rows.withColumns({"flops": F.col("fp32_ops") + F.col("fp64_ops") + F.col("fp16_ops") * 0.5, "bytes": F.greatest("dram_bytes", F.lit(0.0)), "secs": F.col("duration_ns") / 1e9})
    rows = rows.withColumns(
        {
            "ai": F.when(F.col("bytes") > 0, F.col("flops") / F.col("bytes")).otherwise(F.lit(float("inf"))), "achieved_tflops": F.col("flops") / F.col("secs") / 1e12,
            "achieved_gbs": F.col("bytes") / F.col("secs") / 1e9, "ridge": ridge(F.col("d_fp32_tflops"), F.col("d_bandwidth_gbs")), "ops": F.greatest("flops", F.lit(1e-30)),
        }
    )
    level = lambda c: F.when(F.col(c) > 0, F.col("flops") / F.col(c)).otherwise(0.0)
    src = F.col("source")
    label = F.when(src == "perf_llcproxy", F.lit("hw_counters(LLC proxy — write traffic missing)")).when(src.isin("ncu", "rocprof", "likwid", "perf_uncore"), F.concat(F.lit("hw_counters("), src, F.lit(")")))
    bound = F.when((F.col("bytes") == 0) | ((F.col("ai") != float("inf")) & (F.col("ai") >= F.col("ridge"))), "compute").otherwise("memory")
    return rows.select(
        "kernel_name", "duration_ns", "flops", "bytes", "ai", "achieved_tflops", "achieved_gbs",
        F.least(100 * F.col("achieved_tflops") / F.greatest("d_fp32_tflops", F.lit(1e-9)), F.lit(999.0)).alias("flops_pct"),
        F.least(100 * F.col("achieved_gbs") / F.greatest("d_bandwidth_gbs", F.lit(1e-9)), F.lit(999.0)).alias("bw_pct"), bound.alias("bound"), "ridge",
        F.coalesce(label, F.when(src != "", src), F.lit("hardware_counters")).alias("data_source"), (F.col("fp64_ops") / F.col("ops")).alias("fp64_fraction"), (F.col("fp16_ops") * 0.5 / F.col("ops")).alias("fp16_fraction"),
        level("l2_bytes").alias("l2_ai"), level("l1_bytes").alias("l1_ai"), level("l3_bytes").alias("l3_ai"), "occupancy_pct", "ipc",
    )


def arch_group(arch: Column) -> Column:
    """The architecture whose tables hold; SASS for unknown ones."""
    out = F.lit("sass")
    for key, all_ in ARCH.items():
        out = F.when(F.lower(arch).isin([a for a in all_ if (key, a) not in (("x86", "i386"), ("aarch64", "arm"))]), F.lit(key)).otherwise(out)
    return out


def flops_of(arch: Column, itype: Column) -> Column:
    table = {f"{a}/{t}": v for a, ts in FLOPS.items() for t, v in ts.items()}
    return F.coalesce(_dim(F.concat(arch_group(arch), F.lit("/"), itype), table), F.lit(0.0))


def static_kernels(lines: DataFrame) -> DataFrame:
    """FLOPs and bytes of one thread of each kernel, from its instructions."""
    by = lines.groupBy("kernel", "arch", "itype").agg(F.count("*").alias("n"))
    memory = F.when(F.col("itype") == "memory", F.col("n") * F.coalesce(_dim(arch_group(F.col("arch")), MEM_BYTES), F.lit(8.0))).otherwise(0.0)
    return by.groupBy("kernel", "arch").agg(F.sum(F.col("n") * flops_of(F.col("arch"), F.col("itype"))).alias("flops_per_thread"), F.sum(memory).alias("bytes_per_thread"))


def static_roofline(spans: DataFrame, lines: DataFrame, devices: DataFrame) -> DataFrame:
    """Metrics of each disassembled kernel's longest span, on the device of its category."""
    order = lines.groupBy("kernel").agg(F.min("pos").alias("pos"))
    # the longest span of each name first: names are bound to kernels, not spans
    key = F.struct("duration_ns", (-F.col("seq")).alias("first"))
    named = spans.groupBy("name").agg(F.max_by(F.struct("category", "duration_ns", "tags"), key).alias("s"), F.max(key).alias("k"))
    bound_to = kernel_binding(named.select("name"), order)
    rows = named.join(bound_to, "name").groupBy("kernel").agg(F.max_by("s", "k").alias("s")).select("kernel", "s.*").where("duration_ns > 0")
    rows = device_of(rows.join(static_kernels(lines), "kernel"), devices).withColumn("threads", N.threads(F.col("tags")))
    d = devices.select("device_idx", F.col("fp32_tflops").alias("d32"), F.col("bandwidth_gbs").alias("dbw"))
    rows = rows.join(F.broadcast(d), "device_idx").withColumns({"flops": F.col("flops_per_thread") * F.col("threads"), "bytes": F.col("bytes_per_thread") * F.col("threads"), "secs": F.col("duration_ns") / 1e9})
    rows = rows.withColumns({"ai": F.when(F.col("bytes") > 0, F.col("flops") / F.col("bytes")).otherwise(F.lit(float("inf"))), "ridge": ridge(F.col("d32"), F.col("dbw")), "achieved_tflops": F.col("flops") / F.col("secs") / 1e12, "achieved_gbs": F.col("bytes") / F.col("secs") / 1e9})
    bound = F.when((F.col("bytes") == 0) | (F.col("ai") >= F.col("ridge")), "compute").otherwise("memory")
    return rows.select("kernel", "arch", "device_idx", "duration_ns", "threads", "flops", "bytes", "ai", "achieved_tflops", "achieved_gbs", bound.alias("bound"), "ridge")


def headroom(metrics: DataFrame, device: DataFrame) -> DataFrame:
    """The roof above each kernel, and how far it is."""
    d = device.select(F.col("fp32_tflops").alias("d32"), F.col("bandwidth_gbs").alias("dbw"))
    rows = metrics.crossJoin(F.broadcast(d))
    rows = rows.withColumn("ceiling_tflops", F.when(F.col("ai") > 0, F.least(F.col("ai") * F.col("dbw") / 1000, F.col("d32"))).otherwise(0.0))
    return rows.withColumn("headroom", F.when(F.col("achieved_tflops") > 0, F.col("ceiling_tflops") / F.col("achieved_tflops")).otherwise(F.lit(float("inf")))).drop("d32", "dbw")


def plottable(metrics: DataFrame) -> DataFrame:
    return metrics.where("achieved_tflops > 0 and ai > 0")


def axis_ranges(metrics: DataFrame, device: DataFrame) -> DataFrame:
    """Decades of both axes: two at least, with room beside the points and the ridge."""
    d = device.select(F.greatest("fp32_tflops", F.lit(1e-9)).alias("peak"), ridge(F.col("fp32_tflops"), F.col("bandwidth_gbs")).alias("r0")).withColumn("r", F.when(F.col("r0") > 0, F.col("r0")).otherwise(1.0))
    real = (F.col("ai") > 0) & (F.col("ai") < 1e9) & (F.col("flops") > 0)
    one = metrics.agg(F.min(F.when(real, F.col("ai"))).alias("lo"), F.max(F.when(real, F.col("ai"))).alias("hi"), F.min(F.when(F.col("achieved_tflops") > 0, F.col("achieved_tflops"))).alias("tp"), F.coalesce(F.bool_or((F.col("flops") > 0) & (F.col("ai") >= 1e9)), F.lit(False)).alias("inf"))
    rows = one.crossJoin(d).withColumns({"lo": F.coalesce("lo", "r"), "hi": F.coalesce("hi", "r"), "tp": F.coalesce("tp", F.col("peak") * 0.01)})
    rows = rows.withColumn("hi", F.when(F.col("inf"), F.greatest("hi", F.col("r") * 100)).otherwise(F.col("hi")))
    rows = rows.withColumns({"x_lo": F.log10(F.greatest(F.least(F.col("lo") / 5, F.col("r") / 50), F.lit(1e-5))), "x_hi": F.log10(F.greatest("hi", "r") * 10), "y_lo": F.log10(F.greatest(F.col("tp") / 5, F.lit(1e-9))), "y_hi": F.log10(F.col("peak") * 3)})
    return rows.select("x_lo", F.greatest(F.col("x_hi"), F.col("x_lo") + 2).alias("x_hi"), F.least(F.col("y_lo"), F.col("y_hi") - 2).alias("y_lo"), "y_hi")


def ceilings(device: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Lines of a roofline plot: name and end points (x in FLOPs/byte, y in TFLOP/s)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in device.columns else F.lit(0.0)
    peak, bw, l2, l3, f64, f16, tc = (zero(c) for c in ("fp32_tflops", "bandwidth_gbs", "l2_bandwidth_gbs", "l3_bandwidth_gbs", "fp64_tflops", "fp16_tflops", "tensor_tflops"))
    r = ridge(peak, bw)
    meets = lambda gbs: F.when(gbs > 0, peak * 1e12 / (gbs * 1e9)).otherwise(r)
    at_least = lambda x: F.greatest(x, F.lit(LEFT))
    slope = lambda name, gbs, to, when: F.struct(F.lit(name).alias("line"), F.lit(LEFT).alias("x0"), to.alias("x1"), (F.lit(LEFT) * gbs / 1000).alias("y0"), (to * gbs / 1000).alias("y1"), when.alias("shown"))
    flat = lambda name, y, start, when: F.struct(F.lit(name).alias("line"), at_least(start).alias("x0"), F.lit(RIGHT).alias("x1"), y.alias("y0"), y.alias("y1"), when.alias("shown"))
    start = F.least(r, F.when(l2 > 0, meets(l2)).otherwise(r), F.when(l3 > 0, meets(l3)).otherwise(r))
    yes = F.lit(True)
    low64 = (f64 > 0) & (f64 < peak * 0.95)
    lines = [
        slope("dram", bw, r, yes), flat("fp32", peak, start, yes), slope("l2", l2, at_least(meets(l2)), l2 > 0), slope("l3", l3, at_least(meets(l3)), l3 > 0),
        flat("fp64", f64, ridge(f64, bw), low64), slope("fp64_slope", bw, ridge(f64, bw), low64), flat("fp16", f16, ridge(f16, bw), f16 > peak * 1.05), flat("tensor", tc, ridge(tc, bw), tc > f16 * 1.05),
    ]
    rows = device
    if metrics is not None:
        occ = metrics.agg(F.avg(F.when(F.col("occupancy_pct") > 0, F.col("occupancy_pct"))).alias("occ"))
        rows = rows.crossJoin(F.broadcast(occ))
        y = peak * F.coalesce("occ", F.lit(0.0)) / 100
        lines.append(flat("occupancy", y, F.when(y > 0, ridge(y, bw)).otherwise(r), F.coalesce(F.col("occ") < 80, F.lit(False))))
    return rows.select(F.explode(F.array(*lines)).alias("l")).where("l.shown").select("l.line", "l.x0", "l.x1", "l.y0", "l.y1")


def points(metrics: DataFrame, device: DataFrame) -> DataFrame:
    """Where kernels go on the plot, how large, and whether their FLOPs were measured."""
    d = device.select(F.col("bandwidth_gbs").alias("dbw"))
    rows = metrics.crossJoin(F.broadcast(d))
    x = F.greatest(F.when(F.col("ai") < 1e9, F.col("ai")).otherwise(F.col("ridge") * 100), F.lit(LEFT))
    y = F.when((F.col("bound") == "memory") & (F.col("ai") > 0), F.least(F.col("achieved_tflops"), F.col("ai") * F.col("dbw") / 1000)).otherwise(F.col("achieved_tflops"))
    size = F.greatest(F.lit(10.0), 8 + 4 * F.log10(F.greatest(F.col("duration_ns"), F.lit(1)) / 1e6))
    name = "kernel_name" if "kernel_name" in metrics.columns else "kernel"
    return rows.select(F.col(name).alias("kernel"), "bound", x.alias("x"), F.greatest(y, F.lit(FLOOR)).alias("y"), size.alias("size"), (F.col("flops") > 0).alias("measured"))


def likwid_counters(values: DataFrame) -> DataFrame:
    """Whole-program counters from LIKWID sums (group, metric, value); no row without runtime or any work."""
    g = lambda group, metric: F.coalesce(F.max(F.when((F.col("group") == group) & (F.col("metric") == metric), F.col("value"))), F.lit(0.0))
    one = values.agg(
        g("FLOPS_DP", "Runtime (RDTSC) [s]").alias("s"), g("FLOPS_DP", "DP [MFLOPS/s]").alias("dp"), g("FLOPS_DP", "SP [MFLOPS/s]").alias("sp"), g("FLOPS_DP", "AVX512 [MFLOPS/s]").alias("avx"),
        g("MEM_DP", "Memory BW [MBytes/s]").alias("bw1"), g("MEM_DP", "Memory bandwidth [MBytes/s]").alias("bw2"), g("MEM_DP", "Memory data volume [GBytes]").alias("gb"),
    )
    bw = F.when(F.col("bw1") != 0, F.col("bw1")).otherwise(F.col("bw2"))
    out = one.where("s > 0").select(
        F.lit("(whole program)").alias("kernel_name"), (F.col("sp") * F.col("s") * 1e6 + F.col("avx") * F.col("s") * 1e6).alias("fp32_ops"), (F.col("dp") * F.col("s") * 1e6).alias("fp64_ops"), F.lit(0.0).alias("fp16_ops"),
        F.when(F.col("gb") > 0, F.col("gb") * 1e9).otherwise(bw * F.col("s") * 1e6).alias("dram_bytes"), F.lit(0.0).alias("l2_bytes"), F.lit(0.0).alias("l1_bytes"), (F.col("s") * 1e9).cast("bigint").alias("duration_ns"),
        F.lit(0.0).alias("sm_cycles_elapsed"), F.lit(0.0).alias("sm_cycles_max"), F.lit("likwid").alias("source"), F.lit(0.0).alias("l3_bytes"), F.lit(0.0).alias("occupancy_pct"), F.lit(0.0).alias("ipc"),
    )
    return out.where("fp32_ops <> 0 or fp64_ops <> 0 or dram_bytes <> 0")


# Which CPU counters to prefer.
TIERS = ["likwid", "perf_uncore", "perf_llc", "perf_amd", "perf_llcproxy"]


def best_source(candidates: DataFrame) -> DataFrame:
    """Of counters from several tools the most exact ones; of equally exact ones the first by their values."""
    rank = F.coalesce(_dim(F.col("source"), {t: i for i, t in enumerate(TIERS)}), F.lit(len(TIERS)))
    return candidates.withColumn("rank", rank).orderBy("rank", *candidates.columns).limit(1).drop("rank")


def by_device(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("device_idx").agg(F.count("*").alias("kernels"), F.max("achieved_tflops").alias("best_tflops"))


def raster(metrics: DataFrame, device: DataFrame, width: int = 60, height: int = 16) -> list[str]:
    """A roofline in characters: kernels by letter, A to Z and a to z in turn (driver-side; the points of a plot are few)."""
    import math

    a = axis_ranges(metrics, device).first()
    d = device.select("fp32_tflops", "bandwidth_gbs").first()
    grid = [[" "] * width for _ in range(height)]
    row = lambda y: height - 1 - round((math.log10(max(y, 1e-12)) - a.y_lo) / (a.y_hi - a.y_lo) * (height - 1))
    for c in range(width):
        x = 10 ** (a.x_lo + (a.x_hi - a.x_lo) * c / (width - 1))
        r = row(min(x * d.bandwidth_gbs / 1000, d.fp32_tflops))
        if 0 <= r < height:
            grid[r][c] = "─" if x * d.bandwidth_gbs / 1000 >= d.fp32_tflops else "╱"
    for k, p in enumerate(points(metrics, device).orderBy("kernel").collect()):
        c, r = round((math.log10(p.x) - a.x_lo) / (a.x_hi - a.x_lo) * (width - 1)), row(p.y)
        if 0 <= c < width and 0 <= r < height:
            grid[r][c] = chr(65 + k % 52) if k % 52 < 26 else chr(71 + k % 52)
    return ["".join(line) for line in grid]
