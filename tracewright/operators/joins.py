"""Look-ups between the tables of a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def within(inner: DataFrame, small: str, outer: DataFrame, large: str, size: int = 4) -> DataFrame:
    """(small, large): texts of ``inner`` with those of ``outer`` that hold them.

    A text is looked up by its first ``size`` characters (all, if it has fewer) among the pieces
    of that length of the others: an equal join, whatever the sizes.
    """
    key = inner.select(F.col(small), F.left(F.col(small), F.lit(size)).alias("k"))
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length(large), F.lit(1))))
    pieces = outer.select(F.col(large), at.alias("i")).select(large, F.explode(F.array(*[F.substring(F.col(large), F.col("i"), F.lit(n)) for n in range(size + 1)])).alias("k")).distinct()
    return key.join(pieces, "k").where(F.col(large).contains(F.col(small))).select(small, large).distinct()


def kernel_binding(spans: DataFrame, kernels: DataFrame) -> DataFrame:
    """Which disassembled kernel (kernel, pos) each span name belongs to.

    In order: the same name; the name's short form; a kernel whose short form or
    suffix is that; a kernel name within the span's name or the other way round
    (the first in order of disassembly).  Only distinct names are compared, and the
    substring step, for names that nothing else has bound, is a join by pieces of names.
    """
    want = spans.select("name").distinct().withColumn("short", N.short_kernel(F.col("name")))
    have = kernels.groupBy("kernel").agg(F.min("pos").alias("pos"))
    alias = have.select("kernel", "pos", F.explode(F.array(N.short_kernel(F.col("kernel")), N.suffix_name(F.col("kernel")))).alias("alias"))
    alias = alias.groupBy("alias").agg(F.max_by("kernel", "pos").alias("k3"))
    exact = have.select(F.col("kernel").alias("name"), F.col("kernel").alias("k1"))
    short = have.select(F.col("kernel").alias("short"), F.col("kernel").alias("k2"))
    step = want.join(exact, "name", "left").join(short, "short", "left").join(alias.withColumnRenamed("alias", "short"), "short", "left")
    step = step.select("name", F.coalesce("k1", "k2", "k3").alias("kernel"))
    open_ = step.where("kernel is null").select("name")
    part = within(have, "kernel", open_, "name").unionByName(within(open_, "name", have, "kernel").select("kernel", "name")).join(have, "kernel")
    part = part.groupBy("name").agg(F.min_by("kernel", "pos").alias("kernel"))
    return step.where("kernel is not null").unionByName(part)


def device_of(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """``rows`` (category) with device_idx: the first device of that backend, the CPU for CPU-like categories, else the first."""
    first = devices.groupBy("backend").agg(F.min("device_idx").alias("own"))
    cpu = devices.agg(F.min(F.when(F.col("backend") == "cpu", F.col("device_idx"))).alias("cpu"), F.min("device_idx").alias("any"))
    out = rows.join(F.broadcast(first), rows.category == first.backend, "left").crossJoin(F.broadcast(cpu))
    like_cpu = F.when(F.col("category").isin("openmp", "cpu", "opencl"), F.col("cpu"))
    either = F.when(F.col("own").isNotNull() & like_cpu.isNotNull(), F.least("own", like_cpu)).otherwise(F.coalesce("own", like_cpu))
    return out.withColumn("device_idx", F.coalesce(either, F.col("any"))).drop("backend", "own", "cpu", "any")


# Stall reasons of sampled program counters.
STALLS = {
    1: "none", 2: "inst_fetch", 3: "exec_dep", 4: "mem_dep", 5: "texture", 6: "sync",
    7: "const_mem", 8: "pipe_busy", 9: "mem_throttle", 10: "not_sel", 11: "other", 12: "sleeping",
}


def pc_heat(samples: DataFrame, by: str = "func_name") -> DataFrame:
    """Share of a kernel's samples at each program counter, and the commonest stall there."""
    pair = samples.groupBy(by, "pc_offset", "stall_reason").agg(F.sum("count").alias("c"))
    pc = pair.groupBy(by, "pc_offset").agg(F.sum("c").alias("samples"), F.max_by("stall_reason", F.struct("c", -F.col("stall_reason"))).alias("stall"))
    names = F.create_map(*[F.lit(x) for kv in STALLS.items() for x in kv])
    share = F.lit(100.0) * F.col("samples") / F.sum("samples").over(Window.partitionBy(by))
    return pc.select(by, "pc_offset", "samples", share.alias("pct"), F.coalesce(names[F.col("stall").cast("int")], F.lit("")).alias("stall_reason"))


def annotate_heat(lines: DataFrame, samples: DataFrame, mangled: DataFrame | None = None) -> DataFrame:
    """Disassembly lines with sample shares and stalls; kernels by name, else by their mangled name (kernel, mangled_name)."""
    heat = pc_heat(samples).withColumnRenamed("func_name", "kernel")
    if mangled is not None:
        own = heat.join(lines.select("kernel").distinct(), "kernel", "left_semi")
        other = heat.join(lines.select("kernel").distinct(), "kernel", "left_anti").withColumnRenamed("kernel", "mangled_name")
        heat = own.unionByName(other.join(mangled.select("kernel", "mangled_name"), "mangled_name").select(own.columns))
    heat = heat.select("kernel", F.col("pc_offset").alias("addr"), F.col("pct").alias("sample_pct"), "stall_reason")
    return lines.drop("sample_pct", "stall_reason").join(heat, ["kernel", "addr"], "left")


def source_lines(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Disassembly lines with file and line by address (kernel, addr, file, line)."""
    keys = [c for c in ("kernel", "addr") if c in table.columns]
    return lines.drop("source_file", "source_line").join(table.select(*keys, F.col("file").alias("source_file"), F.col("line").alias("source_line")), keys, "left")


def annotate_frames(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """seq and stack_frames with ``(file:line)`` where (library, offset) is known; distinct frames are looked up once."""
    rows = spans.where("size(stack_frames) > 0").select("seq", F.posexplode("stack_frames").alias("pos", "frame"))
    frame = rows.select("frame").distinct().withColumns({"lib": N.frame_library(F.col("frame")), "offset": N.frame_offset(F.col("frame"))})
    known = frame.join(symbols.select("lib", "offset", "file", "line"), ["lib", "offset"]).select("frame", N.frame_with_source(F.col("frame"), F.col("file"), F.col("line")).alias("new"))
    out = rows.join(known, "frame", "left").select("seq", "pos", F.coalesce("new", "frame").alias("frame"))
    return out.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"]).alias("stack_frames"))


def nearest_symbol(addresses: DataFrame, symbols: DataFrame, by: list[str] | None = None, cells: int = 256) -> DataFrame:
    """addr with the symbol at or before it (an as-of join), and the distance to it; size bounds it where ``symbols`` has one.

    Addresses and symbols are sorted together once; the last symbol seen is
    carried along.  Groups are cut into ranges of addresses, and each range
    starts with the last symbol before it, so no task sorts a whole group.
    """
    by = by or []
    both = addresses.select(*by, "addr", F.lit(1).alias("side"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("size"))
    size = F.col("size") if "size" in symbols.columns else F.lit(None)
    one = symbols.select(*by, "addr", F.lit(0).alias("side"), "name", size.cast("bigint").alias("size")).groupBy(*by, "addr", "side").agg(F.min_by(F.struct("name", "size"), "name").alias("s")).select(*by, "addr", "side", "s.name", "s.size")
    rows = one.unionByName(both)
    ends = rows.agg(F.min("addr").alias("a0"), F.max("addr").alias("a1"))
    width = F.greatest(F.ceil((F.col("a1") - F.col("a0") + 1) / cells).cast("bigint"), F.lit(1))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("cell", F.floor((F.col("addr") - F.col("a0")) / width)).drop("a0", "a1")
    last = rows.where("side = 0").groupBy(*by, "cell").agg(F.max_by(F.struct(F.col("addr").alias("at"), "name", "size"), "addr").alias("s"))
    # the last symbol of all cells before; there are few cells
    w = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = rows.select(*by, "cell").distinct().join(last, [*by, "cell"], "left").withColumn("before", F.last("s", ignorenulls=True).over(w)).drop("s")
    inside = Window.partitionBy(*by, "cell").orderBy("addr", "side").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("side") == 0, F.struct(F.col("addr").alias("at"), "name", "size")), ignorenulls=True).over(inside)
    out = rows.withColumn("here", here).where("side = 1").join(cell, [*by, "cell"]).withColumn("s", F.coalesce("here", "before"))
    ok = F.col("s.size").isNull() | (F.col("addr") < F.col("s.at") + F.col("s.size"))
    return out.select(*by, "addr", F.when(ok, F.col("s.name")).alias("symbol"), F.when(ok, F.col("addr") - F.col("s.at")).alias("offset"))


def first_location(spans: DataFrame) -> DataFrame:
    """The source position of each name's first span that has one."""
    rows = spans.where("tags['file'] is not null").select("name", "seq", F.concat_ws(":", F.col("tags")["file"], F.col("tags")["line"]).alias("location"))
    return rows.groupBy("name").agg(F.min_by("location", "seq").alias("location"))


def kernel_list(spans: DataFrame, kernels: DataFrame) -> DataFrame:
    """Profiled kernels, heaviest first, then those only disassembled."""
    by = spans.groupBy("name").agg(F.sum("duration_ns").alias("total_ns"))
    have = kernels.select(F.col("kernel").alias("name")).distinct()
    seen = by.join(have, "name", "left_semi").withColumn("profiled", F.lit(True))
    rest = have.join(by, "name", "left_anti").select("name", F.lit(0).cast("bigint").alias("total_ns"), F.lit(False).alias("profiled"))
    return seen.unionByName(rest)
