"""Samples and counters of perf, and folded stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import perf_event, symbol
from ..schema import empty_tags
from ..operators.ranges import running
from .lines import explode_lines, numbered

def read(spark: SparkSession, path: str) -> DataFrame:
    """block, pos, value: the numbered lines of files of samples, with or without blank lines between these."""
    return numbered(spark, path).withColumnRenamed("file", "block")


def _words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, "[\\t\\r]", " ")), " +")


def _is_hex(c: Column) -> Column:
    """Whether a word can be an address: nothing is left of it without hexadecimal digits."""
    return (c != "") & (F.translate(c, "0123456789abcdef", "") == "")


def _function(words: Column) -> Column:
    """The function of an ``address function (object)`` list of words; address and object may be missing."""
    rest = F.when((F.size(words) > 1) & _is_hex(F.get(words, F.lit(0))), F.slice(words, 2, F.size(words))).otherwise(words)
    text = F.concat(F.lit(" "), F.array_join(rest, " "))
    object_ = F.when(text.endswith(")"), F.length(F.substring_index(text, " (", -1)) + 2).otherwise(0)
    return F.trim(F.left(text, F.length(text) - F.when(object_ > F.length(text), 0).otherwise(object_)))


def samples(blocks: DataFrame) -> DataFrame:
    """comm, pid, tid, start_ns, symbol and frames (outermost first) of each sample, flat or with stacks.

    Lines are taken apart by position.  A header holds a time stamp, the first
    word that is a decimal number and a colon: before it come the command and
    the process (``pid`` or ``pid/tid``), behind it the event (``count name:``) and, in
    the flat form, the frame.  A frame is ``address function (object)``, indented.
    """
    rows = explode_lines(blocks, "block").where(F.trim("value") != "")
    rows = rows.withColumn("w", _words(F.col("value")))
    stamps = F.transform("w", lambda x: x.endswith(":") & x.contains(".") & F.rtrim(F.translate(x, ":", "")).try_cast("decimal(30,9)").isNotNull())
    rows = rows.withColumn("t", F.array_position(stamps, True).cast("int"))
    # the processor, in brackets, may stand between
    rows = rows.withColumn("at", F.col("t") - F.when(F.get("w", F.col("t") - 2).startswith("["), 3).otherwise(2))
    who = F.split(F.get("w", F.col("at")), "/")
    rows = rows.withColumn("head", (F.col("at") >= 1) & F.get(who, F.lit(0)).try_cast("bigint").isNotNull())
    rows = running(rows, ["block"], ["pos"], {"sample": ("max", F.when(F.col("head"), F.col("pos")))}).where("sample is not null")
    stamp = F.translate(F.get("w", F.col("t") - 1), ":", "").try_cast("decimal(30,9)")
    event = F.slice("w", F.col("t") + 1, F.size("w"))
    counted = F.get(event, F.lit(0)).try_cast("bigint").isNotNull() & F.get(event, F.lit(1)).endswith(":")
    named = F.get(event, F.lit(0)).endswith(":")
    behind = F.when(counted, F.slice(event, 3, F.size("w"))).when(named, F.slice(event, 2, F.size("w"))).otherwise(event)
    heads = rows.where("head").withColumn("behind", behind).select(
        "block", "sample", F.array_join(F.slice("w", 1, F.greatest(F.col("at"), F.lit(0))), " ").alias("comm"), F.get(who, F.lit(0)).try_cast("bigint").alias("pid"), F.get(who, F.lit(1)).try_cast("bigint").alias("tid"),
        F.floor(stamp * 1_000_000_000).cast("bigint").alias("start_ns"), symbol(_function(F.col("behind"))).alias("symbol"),
    )
    indented = F.substring("value", 1, 1).isin(" ", "\t") & (F.size("w") > 1) & _is_hex(F.get("w", F.lit(0))) & (F.length(F.get("w", F.lit(0))) >= 4)
    frames = rows.where(~F.col("head") & indented).select("block", "sample", "pos", symbol(_function(F.col("w"))).alias("f")).where("f <> ''")
    frames = frames.groupBy("block", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("o"), "f"))), lambda x: x["f"]).alias("frames"))
    out = heads.join(frames, ["block", "sample"], "left")
    return out.select("block", "sample", "comm", "pid", F.coalesce("tid", "pid").alias("tid"), "start_ns", "symbol", F.coalesce("frames", F.array().cast("array<string>")).alias("frames"))


def spans(found: DataFrame) -> DataFrame:
    """One span without duration for each frame of each sample (counts by name are inclusive), or for its symbol."""
    folded = F.array_join("frames", ";")
    stacked = found.where("size(frames) > 0").select("block", "sample", "pid", "tid", "start_ns", F.posexplode("frames").alias("depth", "name"), folded.alias("folded"))
    stacked = stacked.select("block", "sample", "depth", "name", "pid", "tid", "start_ns", F.create_map(F.lit("depth"), F.col("depth").cast("string"), F.lit("stack"), "folded").alias("tags"))
    flat = found.where("size(frames) = 0").select("block", "sample", F.lit(0).alias("depth"), F.when(F.col("symbol") == "", "[cpu]").otherwise(F.col("symbol")).alias("name"), "pid", "tid", "start_ns", empty_tags().alias("tags"))
    out = stacked.unionByName(flat)
    empty = F.array().cast("array<string>")
    # numbered after a range sort: in order of arrival however many blocks, samples and frames there are
    out = out.orderBy("block", "sample", "depth").withColumn("seq", F.monotonically_increasing_id())
    return out.select("seq", "name", F.lit("cpu").alias("category"), "start_ns", F.lit(0).cast("bigint").alias("duration_ns"), F.col("start_ns").alias("end_ns"), "pid", "tid", "tags", empty.alias("stack_frames"), F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"))


def folded(found: DataFrame) -> DataFrame:
    """stack, count: samples with stacks by command and frames."""
    rows = found.where("size(frames) > 0").select(F.concat_ws(";", "comm", F.array_join("frames", ";")).alias("stack"))
    return rows.groupBy("stack").agg(F.count("*").alias("count"))


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    return folded_lines(spark.read.text(path))


def folded_lines(lines: DataFrame) -> DataFrame:
    """stack, count of folded-stack lines (value); lines without a count are left out."""
    rows = lines.select(F.trim("value").alias("value"))
    pattern = r"^(.*)\s(\d+)$"
    out = rows.where(F.col("value").rlike(pattern)).select(F.trim(F.regexp_extract("value", pattern, 1)).alias("stack"), F.regexp_extract("value", pattern, 2).try_cast("bigint").alias("count"))
    return out.where("count is not null and stack <> ''")


# ------------------------------------------------------------------ perf stat


def stat_events(texts: DataFrame) -> DataFrame:
    """file, event, value of counter lines (value: whole texts)."""
    rows = explode_lines(texts, "file").select("file", F.trim("value").alias("v")).where(F.col("v").rlike("^[0-9]"))
    part = F.split("v", r"\s{2,}", 3)
    rows = rows.where(F.size(part) >= 2).select("file", perf_event(part[1]).alias("event"), F.regexp_replace(part[0], "[^0-9]", "").try_cast("double").alias("value"))
    return rows.where("value is not null and event <> ''").groupBy("file", "event").agg(F.sum("value").alias("value"))


def elapsed(texts: DataFrame) -> DataFrame:
    """file, duration_ns from the line of elapsed seconds, 0 where there is none."""
    text = F.regexp_replace(F.regexp_extract("value", r"(?i)([\d,.]+)\s+seconds\s+time\s+elapsed", 1), ",", ".")
    return texts.select("file", F.coalesce(F.floor(text.try_cast("double") * 1e9).cast("bigint"), F.lit(0).cast("bigint")).alias("duration_ns"))


def read_stat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def _pivot(events: DataFrame) -> tuple[DataFrame, callable]:
    one = events.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("event", "value"))).alias("ev"))  # a file has a few dozen events
    return one, lambda k: F.coalesce(F.col("ev")[k], F.lit(0.0))


def microarch(texts: DataFrame) -> DataFrame:
    """file, name, value: instructions per cycle, cache and branch misses."""
    one, g = _pivot(stat_events(texts))
    rows = one.select(
        "file",
        F.explode(F.array(
            F.struct(F.lit("ipc").alias("name"), F.when((g("cycles") > 0) & (g("instructions") > 0), g("instructions") / g("cycles")).alias("value")),
            F.struct(F.lit("cache_miss_pct").alias("name"), F.when(g("cache-references") > 0, 100.0 * g("cache-misses") / g("cache-references")).alias("value")),
            F.struct(F.lit("branch_miss_pct").alias("name"), F.when(g("branches") > 0, 100.0 * g("branch-misses") / g("branches")).alias("value")),
        )).alias("m"),
    )
    return rows.select("file", "m.name", "m.value").where("value is not null")


def _counters(one: DataFrame, texts: DataFrame, fp32: Column, fp64: Column, dram: Column, l3: Column, source: str, any_: Column) -> DataFrame:
    zero = F.lit(0.0)
    rows = one.join(elapsed(texts), "file").select("file", fp32.alias("fp32_ops"), fp64.alias("fp64_ops"), dram.alias("dram_bytes"), l3.alias("l3_bytes"), "duration_ns", any_.alias("any_"))
    return rows.where("any_").select(
        F.lit("(whole program)").alias("kernel_name"), "fp32_ops", "fp64_ops", zero.alias("fp16_ops"), "dram_bytes", zero.alias("l2_bytes"), zero.alias("l1_bytes"), "duration_ns", zero.alias("sm_cycles_elapsed"), zero.alias("sm_cycles_max"),
        F.lit(source).alias("source"), "l3_bytes", zero.alias("occupancy_pct"), zero.alias("ipc"),
    )


def intel(texts: DataFrame, uncore: bool = False) -> DataFrame:
    """Whole-program counters of Intel processors: lanes by width, memory traffic from controllers or from cache misses."""
    one, g = _pivot(stat_events(texts))
    name = "fp_arith_inst_retired."
    lanes = lambda kind, *n: sum((g(f"{name}{w}{kind}") * k for w, k in zip(("scalar_", "128b_packed_", "256b_packed_", "512b_packed_"), n)), F.lit(0.0))
    fp32, fp64 = lanes("single", 1, 4, 8, 16), lanes("double", 1, 2, 4, 8)
    dram = (g("cas_count_read") + g("cas_count_write")) * 64 if uncore else g("llc-load-misses") * 64
    return _counters(one, texts, fp32, fp64, dram, g("llc-loads") * 64, "perf_uncore" if uncore else "perf_llcproxy", (fp32 != 0) | (fp64 != 0) | (dram != 0))


def amd(texts: DataFrame) -> DataFrame:
    """Whole-program counters of AMD processors: all operations, less the double ones."""
    one, g = _pivot(stat_events(texts))
    name = "fp_ret_sse_avx_ops."
    fp64 = g(name + "fp64_add_sub_ops") + g(name + "fp64_mult_ops") + g(name + "fp64_mult_add_ops") * 2
    every, dram = g(name + "all"), g("llc-load-misses") * 64
    return _counters(one, texts, F.greatest(F.lit(0.0), every - fp64), fp64, dram, g("llc-loads") * 64, "perf_amd", (every != 0) | (dram != 0))
