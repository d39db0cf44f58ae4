"""Output of counter tools: ncu, rocprof, LIKWID, nvidia-smi, rocm-smi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import snake
from .lines import explode_lines, number

# The tool's metric names.
_INSN = "sm__sass_thread_inst_executed_op_{}_pred_on.sum"
NCU = [_INSN.format(k) for k in ("ffma", "fadd", "fmul", "dfma", "dadd", "dmul", "hfma")] + [
    "dram__bytes.sum", "dram__bytes_read.sum", "dram__bytes_write.sum", "l2tex__t_bytes.sum", "l1tex__t_bytes.sum", "sm__cycles_elapsed.max", "sm__cycles_elapsed.sum", "sm__cycles_active.sum",
    "sm__inst_executed_pipe_tensor_op_hmma_pred_on.sum", "sm__warps_active.avg.pct_of_peak_sustained_active", "sm__inst_executed.sum",
]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, status lines (``==…``) before it skipped; everything as text."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace(F.concat(F.lit("\n"), "value"), r"\n==[^\n]*", ""), "\\Z")).alias("value"))
    texts = [r.value.lstrip("\n") for r in lines.limit(1).collect()]
    header = texts[0].split("\n", 1)[0] if texts else ""
    body = spark.read.text(path).where(~F.col("value").startswith("==") & (F.trim("value") != "") & (F.col("value") != header.rstrip("\r")))
    return csv_rows(body, header.rstrip("\r")) if header else spark.createDataFrame([], "value string")


def csv_rows(lines: DataFrame, header: str) -> DataFrame:
    """Lines (value) as rows with the columns of ``header``, everything as text."""
    names = [c.strip().strip('"') for c in header.split(",")]
    schema = ", ".join(f"`{c or f'c{i}'}` STRING" for i, c in enumerate(names))
    return lines.select(F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")


def ncu(rows: DataFrame) -> DataFrame:
    """Counters of each kernel from (Kernel Name, Metric Name, Metric Value) rows, summed over its launches."""
    r = rows.select(F.trim("`Kernel Name`").alias("kernel_name"), F.trim("`Metric Name`").alias("metric"), number(F.col("`Metric Value`")).alias("value"))
    r = r.where("kernel_name <> '' and metric <> '' and value is not null")
    g = lambda k: F.coalesce(F.sum(F.when(F.col("metric") == k, F.col("value"))), F.lit(0.0))
    i = lambda k: g(_INSN.format(k))
    runs = F.greatest(F.count(F.when(F.col("metric") == "sm__cycles_elapsed.max", 1)), F.lit(1))
    rw = g("dram__bytes_read.sum") + g("dram__bytes_write.sum")
    elapsed = g("sm__cycles_elapsed.sum")
    zero = F.lit(0.0)
    return r.groupBy("kernel_name").agg(
        (i("ffma") * 2 + i("fadd") + i("fmul")).alias("fp32_ops"), (i("dfma") * 2 + i("dadd") + i("dmul")).alias("fp64_ops"), (i("hfma") * 2 + g("sm__inst_executed_pipe_tensor_op_hmma_pred_on.sum") * 512).alias("fp16_ops"),
        F.when((g("dram__bytes_read.sum") == 0) & (g("dram__bytes_write.sum") == 0), g("dram__bytes.sum")).otherwise(rw).alias("dram_bytes"), g("l2tex__t_bytes.sum").alias("l2_bytes"), g("l1tex__t_bytes.sum").alias("l1_bytes"),
        F.lit(0).cast("bigint").alias("duration_ns"), elapsed.alias("sm_cycles_elapsed"), g("sm__cycles_elapsed.max").alias("sm_cycles_max"), F.lit("ncu").alias("source"), zero.alias("l3_bytes"),
        (g("sm__warps_active.avg.pct_of_peak_sustained_active") / runs).alias("occupancy_pct"), F.when(elapsed > 0, g("sm__inst_executed.sum") / elapsed).otherwise(0.0).alias("ipc"),
    )


def rocprof(rows: DataFrame) -> DataFrame:
    """Counters of each dispatch; the columns that are there decide how memory traffic is counted."""
    g = lambda k: F.coalesce(number(F.col(f"`{k}`")), F.lit(0.0)) if k in rows.columns else F.lit(0.0)
    v = lambda k: g(f"SQ_INSTS_VALU_{k}")
    name = F.coalesce(*[F.when(F.trim(f"`{c}`") != "", F.trim(f"`{c}`")) for c in ("Kernel-Name", "KernelName") if c in rows.columns], F.lit(None).cast("string"))
    tile = 16 * 16 * 4 * 2
    fp32 = v("ADD_F32") + v("MUL_F32") + v("FMA_F32") * 2 + v("MFMA_F32_16x16x4") * tile + v("MFMA_F32_32x32x2") * (32 * 32 * 2 * 2)
    fp64 = v("ADD_F64") + v("FMA_F64") * 2 + v("MFMA_F64_16x16x4") * tile
    if "GL2C_MC_RDREQ_sum" in rows.columns:
        dram = (g("GL2C_MC_RDREQ_sum") + g("GL2C_MC_WRREQ_sum")) * 64
    else:
        mixed = lambda k: g(f"TCC_EA_{k}_32B_sum") * 32 + (g(f"TCC_EA_{k}_sum") - g(f"TCC_EA_{k}_32B_sum")) * 64
        dram = mixed("RDREQ") + mixed("WRREQ")
    cache = "GL2C" if "GL2C_HIT_sum" in rows.columns else "TCC"
    zero = F.lit(0.0)
    time = F.when(g("EndNs") > g("BeginNs"), g("EndNs") - g("BeginNs")).otherwise(0.0).cast("bigint")
    return rows.withColumn("k_", name).where("k_ is not null").select(
        F.col("k_").alias("kernel_name"), fp32.alias("fp32_ops"), fp64.alias("fp64_ops"), (v("ADD_F16") + v("FMA_F16") * 2).alias("fp16_ops"), dram.alias("dram_bytes"), ((g(f"{cache}_HIT_sum") + g(f"{cache}_MISS_sum")) * 64).alias("l2_bytes"),
        zero.alias("l1_bytes"), time.alias("duration_ns"), zero.alias("sm_cycles_elapsed"), zero.alias("sm_cycles_max"), F.lit("rocprof").alias("source"), zero.alias("l3_bytes"), zero.alias("occupancy_pct"), zero.alias("ipc"),
    )


# ------------------------------------------------------------------ LIKWID


def likwid_table(texts: DataFrame, group: str) -> DataFrame:
    """file, group, metric, value: the Sum column (or the last) of a group's tables in ``-O`` output."""
    rows = explode_lines(texts, "file").withColumn("value", F.rtrim("value"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("table", F.sum(F.when(F.col("value").startswith("TABLE,"), 1).otherwise(0)).over(w))
    t = Window.partitionBy("file", "table").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    part = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = rows.withColumn("title", F.first("value").over(t)).where(F.col("title").startswith("TABLE,") & F.col("title").contains(group) & (F.col("value") != F.col("title")))
    rows = rows.withColumn("p", part)
    at = F.when(F.array_position("p", "Sum") > 0, F.array_position("p", "Sum").cast("int")).otherwise(F.size("p"))
    rows = rows.withColumn("col", F.last(F.when(F.col("p")[0] == "Metric", at), ignorenulls=True).over(t)).where((F.col("p")[0] != "Metric") & (F.col("p")[0] != ""))
    cell = F.when(F.col("col").isNull() | (F.col("col") > F.size("p")), F.when(F.size("p") >= 2, F.element_at("p", -1))).otherwise(F.try_element_at("p", F.col("col")))
    rows = rows.select("file", "pos", F.col("p")[0].alias("metric"), cell.try_cast("double").alias("value")).where("value is not null")
    return rows.groupBy("file", "metric").agg(F.max_by("value", "pos").alias("value")).select("file", F.lit(group).alias("group"), "metric", "value")


def likwid_metrics(texts: DataFrame) -> DataFrame:
    """file, name, unit, core, value of the ASCII metric tables."""
    rows = explode_lines(texts, "file").withColumn("v", F.trim("value"))
    head = F.col("v").startswith("|") & F.col("v").contains("Metric") & F.col("v").rlike(r"Core\s+\d+")
    edge = ~F.col("v").startswith("|") & ~F.col("v").startswith("+")
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("in_", F.last(F.when(head, F.lit(1)).when(edge | (F.col("v").startswith("|") & F.col("v").contains("Event")), F.lit(0)), ignorenulls=True).over(w)).withColumn("head", head)
    # a rule after data ends a table; the one right below the header doesn't
    cells = F.transform(F.split(F.regexp_replace("v", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.where("in_ = 1 and not head").where(F.col("v").startswith("|")).select("file", "pos", cells.alias("c"))
    rows = rows.select("file", "pos", F.regexp_extract(F.col("c")[0], r"\[([^\]]+)\]", 1).alias("unit"), F.trim(F.regexp_replace(F.col("c")[0], r"\s*\[[^\]]+\]", "")).alias("name"), F.slice("c", 2, F.size("c")).alias("vals")).where("name <> ''")
    values = F.filter(F.transform("vals", lambda x: F.regexp_replace(x, ",", ".").try_cast("double")), lambda x: x.isNotNull())
    return rows.select("file", "pos", "name", "unit", F.posexplode(values).alias("core", "value"))


def likwid_counters(metrics: DataFrame, compat: bool = True) -> DataFrame:
    """Counters by core and, over several cores, the sum of rates and the mean of the rest.

    ``compat`` knows as rates the units MFLOP/s, MByte/s, GB/s and MHz only;
    without it also their plural spellings, and no clocks.
    """
    key = snake(F.col("name"))
    rate = F.col("unit").rlike("MFLOP/s|MByte/s|GB/s|MHz" if compat else "MFLOPS?/s|MBytes?/s|GB/s")
    own = metrics.select("file", F.concat(F.lit("likwid.core"), F.col("core").cast("string"), F.lit("."), key).alias("name"), "value", "unit")
    by = metrics.groupBy("file", "pos", "name", "unit").agg(F.count("*").alias("n"), F.sum("value").alias("s")).where("n > 1")
    all_ = by.select("file", F.concat(F.when(rate, F.lit("likwid.total.")).otherwise(F.lit("likwid.avg.")), key).alias("name"), F.when(rate, F.col("s")).otherwise(F.col("s") / F.col("n")).alias("value"), "unit")
    return own.unionByName(all_)


# ------------------------------------------------------------------ polling


def _gauges(rows: DataFrame, *gauges: tuple[str, Column, str]) -> DataFrame:
    every = [F.struct(F.concat(F.lit(f"{name}[gpu"), F.col("idx").cast("string"), F.lit("]")).alias("name"), value.alias("value"), F.lit(unit).alias("unit")) for name, value, unit in gauges]
    keep = [c for c in ("timestamp_ns",) if c in rows.columns]
    return rows.select(*keep, F.explode(F.array(*every)).alias("g")).select(*keep, "g.name", F.lit("memory").alias("category"), "g.value", "g.unit")


def nvidia_smi(lines: DataFrame) -> DataFrame:
    """Gauges from lines (value, and timestamp_ns where known) of index, GPU and memory utilisation and MiB used."""
    part = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.withColumn("p", part).where(F.size("p") >= 4)
    rows = rows.withColumns({"idx": F.col("p")[0].try_cast("int"), "g": F.col("p")[1].try_cast("double"), "m": F.col("p")[2].try_cast("double"), "mib": F.col("p")[3].try_cast("double")})
    rows = rows.where("idx is not null and g is not null and m is not null and mib is not null")
    return _gauges(rows, ("gpu_utilization_pct", F.col("g"), "%"), ("gpu_mem_util_pct", F.col("m"), "%"), ("gpu_mem_used_bytes", F.col("mib") * 1024 * 1024, "bytes"))


def rocm_smi(texts: DataFrame, kind: str) -> DataFrame:
    """Gauges from a header and card lines (value: whole texts); the header says which column, and its unit."""
    rows = explode_lines(texts, "file").withColumn("v", F.trim("value")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    first = F.first("v").over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("header", F.lower(first)).where(F.lower("v") != F.col("header"))
    names = F.split("header", ",")
    part = F.transform(F.split("v", ","), lambda x: F.trim(x))
    wanted = (lambda h: (h.contains("use") | h.contains("utiliz")) & ~h.contains("mem")) if kind == "use" else (lambda h: h.contains("used"))
    places = F.filter(F.transform(names, lambda h, i: F.when(wanted(h) & (i > 0), i)), lambda i: i.isNotNull())
    col = F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(1 if kind == "use" else None).cast("int"))
    rows = rows.withColumns({"p": part, "col": col, "h": F.try_element_at(names, col + 1)}).where("col is not null and size(p) > col")
    rows = rows.withColumn("idx", F.regexp_replace(F.col("p")[0], "card", "").try_cast("int"))
    value = F.regexp_replace(F.element_at("p", F.col("col") + 1), "%$", "").try_cast("double")
    unit = F.when(F.col("h").contains("(gb)"), 1024.0**3).when(F.col("h").contains("(mb)"), 1024.0**2).when(F.col("h").contains("(kb)"), 1024.0).otherwise(1.0)
    rows = rows.withColumn("x", value).withColumn("u", unit).where("idx is not null and x is not null")
    return _gauges(rows, ("gpu_utilization_pct", F.col("x"), "%")) if kind == "use" else _gauges(rows, ("gpu_mem_used_bytes", F.col("x") * F.col("u"), "bytes"))
