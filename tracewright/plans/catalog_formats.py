"""Text that the tables are written as, read back by every reader and held against the tables; writers held against what they were given."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, formats
from ..operators import context, flame, joins, roofline
from ..sinks import otlp, report, summary, trace_json as sink
from ..sources import disasm, perf, tools, trace_json, wire
from ..streaming import pairing
from . import tools as named
from . import views as V
from .catalog import query

_s = lambda c: F.col(c).cast("string")


def _text(rows: DataFrame, key: str, line: Column, order: str, head: str | Column = "", sep: str = "\n") -> DataFrame:
    """file, value: the lines of each key, in order, below a head."""
    by = rows.select(F.col(key).alias("file"), F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.lit(head) if isinstance(head, str) else head
    return by.select(F.col("file").cast("string").alias("file"), F.concat(head, F.array_join(F.transform("x", lambda x: x["l"]), sep)).alias("value"))


# ------------------------------------------------------------------ saved traces


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    spans = V.spans(s, d).withColumn("stack_frames", F.when(F.col("seq") % 4 == 0, F.array("name", F.lit("main"))).otherwise(F.array().cast("array<string>")))
    counters = V.counters(s, d).select("*", F.lit("memory").alias("category"), F.lit("u").alias("unit"), F.lit(7).cast("bigint").alias("pid"))
    instants = V.spans(s, d).where("category = 'mpi'").select("seq", "name", "category", F.col("start_ns").alias("timestamp_ns"), "pid", "tid")
    return sink.events(spans, instants, counters).select("json")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return trace_json.event_lines(_json_lines(s, d).select(F.lit("t").alias("trace_id"), F.concat("json", F.lit(",")).alias("value")))


_MICROS = "cast(trunc((start_ns / 1000) * 1000) AS bigint) AS start_ns, cast(trunc((duration_ns / 1000) * 1000) AS bigint) AS duration_ns"
query("trace_json_spans", f"SELECT name, category, {_MICROS}, pid, tid, t_type AS type, CASE WHEN seq % 4 = 0 THEN name || ';main' ELSE '' END AS stack, span_id, parent_span_id FROM spans", "spans")(
    lambda s, d: trace_json.spans(_lines(s, d)).select("name", "category", "start_ns", "duration_ns", "pid", "tid", F.col("tags")["type"].alias("type"), F.array_join("stack_frames", ";").alias("stack"), "span_id", "parent_span_id")
)
query("trace_json_counters", "SELECT name, cast(trunc((timestamp_ns / 1000) * 1000) AS bigint) AS timestamp_ns, value, 'u' AS unit, 'memory' AS category, 7::bigint AS pid FROM counters", "counters")(lambda s, d: trace_json.counters(_lines(s, d)).select("name", "timestamp_ns", "value", "unit", "category", "pid"))
query("trace_json_instants", "SELECT name, category, cast(trunc((start_ns / 1000) * 1000) AS bigint) AS timestamp_ns, pid, tid FROM spans WHERE category = 'mpi'", "spans")(lambda s, d: trace_json.instants(_lines(s, d)).select("name", "category", "timestamp_ns", "pid", "tid"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    """A document for each customer: an event, a device and a line of disassembly."""
    event = F.to_json(F.struct(F.lit("X").alias("ph"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "cuda").otherwise("?").alias("cat"), (F.col("c_custkey") * 10).alias("ts"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") + 0.5).alias("dur")))
    device = F.concat(F.lit('{"name":"'), F.col("c_mktsegment"), F.lit('","backend":"cuda","sm_count":'), _s("c_nationkey"), F.lit("}"))
    line = F.concat(F.lit('{"addr":'), _s("c_custkey"), F.lit(',"mnemonic":"mov","operands":"rax, rbx","itype":"scalar"}'))
    text = F.concat(F.lit('{"traceEvents":['), event, F.lit('],"metadata":{"command":"'), "c_name", F.lit('","duration_ms":'), _s("c_nationkey"), F.lit(',"devices":['), device, F.lit(']},"disasm":{"k":{"arch":"x86","lines":['), line, F.lit("]}}}"))
    return trace_json.documents(V.load(s, d, "customer").select(_s("c_custkey").alias("trace_id"), text.alias("value")))


query("trace_documents", "SELECT cast(c_custkey AS varchar) AS trace_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'cuda' ELSE 'other' END AS category, c_custkey * 10000 AS start_ns, cast(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey * 1000 + 500 ELSE 0 END AS bigint) AS duration_ns, 0::bigint AS pid FROM customer")(
    lambda s, d: trace_json.spans(_documents(s, d)).select("trace_id", "name", "category", "start_ns", "duration_ns", "pid")
)
query("trace_document_parts", "SELECT cast(c_custkey AS varchar) AS trace_id, c_name AS command, cast(c_nationkey AS double) AS duration_ms, c_mktsegment AS device, c_nationkey AS sm_count, 'k' AS kernel, c_custkey AS addr, 'mov' AS mnemonic FROM customer")(
    lambda s, d: (lambda doc: trace_json.meta(doc).select("trace_id", "command", "duration_ms").join(trace_json.devices(doc).select("trace_id", F.col("name").alias("device"), "sm_count"), "trace_id").join(trace_json.disasm_lines(doc).select("trace_id", "kernel", "addr", "mnemonic"), "trace_id"))(_documents(s, d))
)
query("category_colours", "SELECT DISTINCT category, CASE category WHEN 'cuda' THEN 'terrible' WHEN 'memory' THEN 'grey' WHEN 'sync' THEN 'white' WHEN 'openmp' THEN 'olive' ELSE 'generic_work' END AS cname FROM spans", "spans")(
    lambda s, d: V.spans(s, d).select("category", sink.colour(F.col("category")).alias("cname")).distinct()
)

# ------------------------------------------------------------------ perf


def _customers(s: SparkSession, d: str) -> DataFrame:
    c, n, r = V.load(s, d, "customer"), V.load(s, d, "nation"), V.load(s, d, "region")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)


def _stacked(s: SparkSession, d: str) -> DataFrame:
    """A block for each customer, some without a thread, with unknown frames and names with blanks."""
    who = F.when(F.col("c_custkey") % 2 == 0, F.concat(_s("c_nationkey"), F.lit("/"), _s("c_custkey"))).otherwise(_s("c_nationkey"))
    text = F.concat(
        F.lit("my app  "), who, F.lit(" "), _s("c_custkey"), F.lit(".500000: 250 cycles:u:\n\t 4005d0 "), "c_mktsegment", F.lit("+0x10 (/app)\n\t   4005d1 [unknown] (/app)\n\t 4004f0 "),
        "n_name", F.lit(" (/lib/x y.so)\n\t ffff4004f1 "), "r_name", F.lit(" ([kernel])"),
    )
    return _customers(s, d).select(F.col("c_custkey").alias("block"), text.alias("value"))


query("perf_stacks", "SELECT c_custkey AS block, 'my app' AS comm, cast(c_nationkey AS bigint) AS pid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_nationkey END AS tid, c_custkey * 1000000000 + 500000000 AS start_ns, r_name || ';' || n_name || ';' || c_mktsegment AS frames FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: perf.samples(_stacked(s, d)).select("block", "comm", "pid", "tid", "start_ns", F.array_join("frames", ";").alias("frames"))
)
query("perf_frames", "WITH c AS (SELECT c_custkey, cast(c_nationkey AS bigint) AS pid, [r_name, n_name, c_mktsegment] AS f FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey * 1000000000 + 500000000 AS start_ns, pid, f[i] AS name, cast(i - 1 AS varchar) AS depth, array_to_string(f, ';') AS stack FROM (SELECT *, unnest([1, 2, 3]) AS i FROM c)")(
    lambda s, d: perf.spans(perf.samples(_stacked(s, d))).select("start_ns", "pid", "name", F.col("tags")["depth"].alias("depth"), F.col("tags")["stack"].alias("stack"))
)
query("perf_folded", "SELECT concat('my app;', r_name, ';', n_name, ';', c_mktsegment) AS stack, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")(lambda s, d: perf.folded(perf.samples(_stacked(s, d))))
query("perf_flat", "SELECT seq AS start_ns, pid, pid AS tid, CASE WHEN seq % 7 = 0 THEN '[cpu]' ELSE name END AS name, 0::bigint AS duration_ns FROM spans", "spans")(
    lambda s, d: perf.spans(
        perf.samples(V.spans(s, d).select(F.col("seq").alias("block"), F.concat(F.lit("app "), _s("pid"), F.lit(" 0."), F.lpad(_s("seq"), 9, "0"), F.lit(": 1 cycles:u: 4005d0 "), F.when(F.col("seq") % 7 == 0, "[unknown]").otherwise(F.concat("name", F.lit("+0x1"))), F.lit(" (/app)")).alias("value")))
    ).select("start_ns", "pid", "tid", "name", "duration_ns")
)
query("folded_lines", "SELECT stack, count FROM folded UNION ALL SELECT stack || ';', count * 2 FROM folded", "folded")(
    lambda s, d: perf.folded_lines(V.folded(s, d).select(F.explode(F.array(F.concat(F.lit("  "), "stack", F.lit(" "), _s("count")), F.concat("stack", F.lit("; "), (F.col("count") * 2).cast("string")), F.col("stack"), F.lit(""), F.concat("stack", F.lit(" x")))).alias("value")))
)


def _stat(s: SparkSession, d: str, *events: tuple[str, str]) -> DataFrame:
    """Counter files of each nation: the number of its customers times a factor for each event, and the elapsed time."""
    by = V.load(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    lines = F.concat(*[F.concat(F.lit("  "), F.format_number(F.col("n") * int(k), 0), F.lit(f"      {e}\n")) for e, k in events], F.lit("\n  "), _s("c_nationkey"), F.lit(".25 seconds time elapsed\n"))
    return by.select(_s("c_nationkey").alias("file"), lines.alias("value"))


_STAT = "FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)"
_COUNTED = lambda df: df.select("duration_ns", "fp32_ops", "fp64_ops", "dram_bytes", "l3_bytes", "source")
query("perf_stat_intel", f"SELECT c_nationkey * 1000000000::bigint + 250000000 AS duration_ns, cast(n * 5000 + n * 8 * 3000 AS double) AS fp32_ops, cast(n * 4 * 2000 AS double) AS fp64_ops, cast(n * 7000 * 64 AS double) AS dram_bytes, cast(n * 9000 * 64 AS double) AS l3_bytes, 'perf_llcproxy' AS source {_STAT}")(
    lambda s, d: _COUNTED(perf.intel(_stat(s, d, ("fp_arith_inst_retired.scalar_single:u", "5000"), ("fp_arith_inst_retired.256b_packed_single", "3000"), ("fp_arith_inst_retired.256b_packed_double:u", "2000"), ("LLC-load-misses", "7000"), ("LLC-loads:u", "9000"))))
)
query("perf_stat_uncore", f"SELECT c_nationkey * 1000000000::bigint + 250000000 AS duration_ns, cast(n * 5000 AS double) AS fp32_ops, 0::double AS fp64_ops, cast(n * 11000 * 64 AS double) AS dram_bytes, 0::double AS l3_bytes, 'perf_uncore' AS source {_STAT}")(
    lambda s, d: _COUNTED(perf.intel(_stat(s, d, ("fp_arith_inst_retired.scalar_single:u", "5000"), ("uncore_imc/cas_count_read/", "4000"), ("uncore_imc/cas_count_write/", "7000")), True))
)
query("perf_stat_amd", f"SELECT c_nationkey * 1000000000::bigint + 250000000 AS duration_ns, cast(n * 5000 - n * 1400 AS double) AS fp32_ops, cast(n * 600 + n * 400 * 2 AS double) AS fp64_ops, cast(n * 70 * 64 AS double) AS dram_bytes, 0::double AS l3_bytes, 'perf_amd' AS source {_STAT}")(
    lambda s, d: _COUNTED(perf.amd(_stat(s, d, ("fp_ret_sse_avx_ops.all", "5000"), ("fp_ret_sse_avx_ops.fp64_add_sub_ops", "600"), ("fp_ret_sse_avx_ops.fp64_mult_add_ops:u", "400"), ("LLC-load-misses", "70"))))
)

# ------------------------------------------------------------------ counter tools


def _ncu(s: SparkSession, d: str) -> DataFrame:
    parts = V.load(s, d, "part")
    values = [("sm__sass_thread_inst_executed_op_ffma_pred_on.sum", F.col("p_partkey") * 1000), ("sm__sass_thread_inst_executed_op_fadd_pred_on.sum", F.col("p_size")), ("sm__sass_thread_inst_executed_op_dfma_pred_on.sum", F.col("p_size") * 2), ("dram__bytes.sum", F.col("p_partkey") * 64), ("sm__cycles_elapsed.max", F.lit(10)), ("sm__cycles_elapsed.sum", F.lit(40)), ("sm__inst_executed.sum", F.lit(80)), ("sm__warps_active.avg.pct_of_peak_sustained_active", F.col("p_size"))]
    line = lambda m, v: F.concat(F.lit('"'), _s("p_partkey"), F.lit('","'), "p_brand", F.lit(f', x","{m}","'), F.format_number(v, 0), F.lit('"'))
    return parts.select(F.explode(F.array(*[line(m, v) for m, v in values])).alias("value"))


query("ncu_counters", "SELECT p_brand || ', x' AS kernel_name, cast(2 * sum(p_partkey) * 1000 + sum(p_size) AS double) AS fp32_ops, cast(4 * sum(p_size) AS double) AS fp64_ops, cast(sum(p_partkey) * 64 AS double) AS dram_bytes, cast(10 * count(*) AS double) AS sm_cycles_max, cast(sum(p_size) AS double) / count(*) AS occupancy_pct, 2::double AS ipc FROM part GROUP BY p_brand")(
    lambda s, d: tools.ncu(tools.csv_rows(_ncu(s, d), '"ID","Kernel Name","Metric Name","Metric Value"')).select("kernel_name", "fp32_ops", "fp64_ops", "dram_bytes", "sm_cycles_max", "occupancy_pct", "ipc")
)
query("rocprof_counters", "SELECT p_name AS kernel_name, cast(p_size + 2 * p_partkey AS double) AS fp32_ops, cast(32 + (p_size - 1) * 64 + 128 AS double) AS dram_bytes, cast((p_partkey + 1) * 64 AS double) AS l2_bytes, p_partkey AS duration_ns FROM part")(
    lambda s, d: tools.rocprof(tools.csv_rows(V.load(s, d, "part").select(F.concat_ws(",", F.concat(F.lit('"'), "p_name", F.lit('"')), _s("p_size"), _s("p_partkey"), _s("p_size"), F.lit("1,2,0"), _s("p_partkey"), F.lit("1,100"), (F.col("p_partkey") + 100).cast("string")).alias("value")), "Kernel-Name,SQ_INSTS_VALU_ADD_F32,SQ_INSTS_VALU_FMA_F32,TCC_EA_RDREQ_sum,TCC_EA_RDREQ_32B_sum,TCC_EA_WRREQ_sum,TCC_EA_WRREQ_32B_sum,TCC_HIT_sum,TCC_MISS_sum,BeginNs,EndNs"))
    .select("kernel_name", "fp32_ops", "dram_bytes", "l2_bytes", "duration_ns")
)


def _likwid(s: SparkSession, d: str) -> DataFrame:
    n = V.load(s, d, "nation")
    text = F.concat(
        F.lit("TABLE,Group 1 Raw,FLOPS_DP,x\nMetric,core 0,core 1,Sum\nRuntime (RDTSC) [s],2.0,2.0,"), _s("n_nationkey"), F.lit("\nDP [MFLOPS/s],100,200,"), (F.col("n_nationkey") * 3).cast("string"),
        F.lit("\nTABLE,Group 2,MEM_DP\nMemory data volume [GBytes],"), (F.col("n_nationkey") * 0.5).cast("string"), F.lit("\n"),
    )
    return n.select(_s("n_nationkey").alias("file"), text.alias("value"))


def _likwid_values(s: SparkSession, d: str) -> DataFrame:
    t = _likwid(s, d)
    return tools.likwid_table(t, "FLOPS_DP").unionByName(tools.likwid_table(t, "MEM_DP"))


query("likwid_tables", "SELECT cast(n_nationkey AS varchar) AS file, g AS \"group\", m AS metric, cast(n_nationkey * f AS double) AS value FROM nation, (VALUES ('FLOPS_DP', 'Runtime (RDTSC) [s]', 1.0), ('FLOPS_DP', 'DP [MFLOPS/s]', 3.0), ('MEM_DP', 'Memory data volume [GBytes]', 0.5)) t(g, m, f)")(lambda s, d: _likwid_values(s, d))
query("likwid_program", "SELECT cast(max(n_nationkey) * 3 * max(n_nationkey) AS double) * 1e6::double AS fp64_ops, cast(max(n_nationkey) AS double) * 0.5 * 1e9::double AS dram_bytes, cast(max(n_nationkey) AS bigint) * 1000000000 AS duration_ns, 'likwid' AS source FROM nation")(lambda s, d: roofline.likwid_counters(_likwid_values(s, d)).select("fp64_ops", "dram_bytes", "duration_ns", "source"))
query("likwid_ascii", "WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT cast(k AS varchar) AS file, m AS name, v AS value FROM n, LATERAL (VALUES ('likwid.core0.clock', k + 0.5::double), ('likwid.core1.clock', k::double), ('likwid.total.clock', 2 * k + 0.5::double), ('likwid.core0.cpi', 1::double), ('likwid.core1.cpi', 2::double), ('likwid.avg.cpi', 1.5::double)) t(m, v)")(
    lambda s, d: tools.likwid_counters(tools.likwid_metrics(V.load(s, d, "nation").select(_s("n_nationkey").alias("file"), F.concat(F.lit("+---+\n|        Metric        |   Core 0   |  Core 1 |\n+----+----+\n| Clock [MHz] | "), _s("n_nationkey"), F.lit(",5 | "), _s("n_nationkey"), F.lit(" |\n| CPI | 1.0 | 2.0 |\n+----+\nrest\n| x | 1 | 2 |\n")).alias("value")))).select("file", "name", "value")
)
query("rocm_polling", "SELECT concat('gpu_utilization_pct[gpu', cast(c_custkey AS varchar), ']') AS name, cast(c_custkey % 101 AS double) AS value FROM customer UNION ALL SELECT concat('gpu_mem_used_bytes[gpu', cast(c_custkey AS varchar), ']'), cast(c_custkey % 7 AS double) * 1048576 FROM customer")(
    lambda s, d: (lambda c: tools.rocm_smi(_text(c, "c_nationkey", F.concat(F.lit("card"), _s("c_custkey"), F.lit(","), (F.col("c_custkey") % 101).cast("string"), F.lit("%")), "c_custkey", "device,GPU use (%)\n"), "use").unionByName(
        tools.rocm_smi(_text(c, "c_nationkey", F.concat(F.lit("card"), _s("c_custkey"), F.lit(",100,"), (F.col("c_custkey") % 7).cast("string")), "c_custkey", "# c\ndevice,VRAM Total (MB),VRAM Used (MB)\n"), "mem")
    ))(V.load(s, d, "customer")).select("name", "value")
)

# ------------------------------------------------------------------ disassembly


def _hex(c: Column, width: int = 4) -> Column:
    digits = F.lower(F.hex(c))
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def _listing(s: SparkSession, d: str, arch: str, line: Column, head: Column) -> DataFrame:
    """A listing for each kernel of an architecture."""
    return _text(V.instructions(s, d).where(F.col("arch") == arch), "kernel", line, "pos").select("file", F.concat(head, "value").alias("value"))


_CODE = lambda: F.concat("mnemonic", F.when(F.col("operands") == "", "").otherwise(F.concat(F.lit(" "), "operands")))
_INSN = lambda arch, addr="pos": f"SELECT kernel, {addr} AS addr, mnemonic, operands FROM insns WHERE arch = '{arch}'"
query("sass_listing", "SELECT kernel, pos AS addr, mnemonic, operands, stall_cycles FROM insns WHERE arch = 'sass'", "insns")(
    lambda s, d: disasm.sass(_listing(s, d, "sass", F.concat(F.lit("        /*"), _hex(F.col("pos")), F.lit("*/   "), F.when(F.col("pos") % 3 == 0, "@!P0 ").otherwise(""), _CODE(), F.lit(" ;  /* 0x0000000402047981 */\n   /* 0x000fc4000000"), F.lit("0"), F.lower(F.hex(F.col("stall_cycles").cast("bigint"))), F.lit("00 */")), F.concat(F.lit("\t\tFunction : "), "file", F.lit("\n"))))
    .select("kernel", "addr", "mnemonic", "operands", "stall_cycles")
)
query("ptx_listing", "SELECT kernel, mnemonic, operands, count(*) AS n FROM insns WHERE arch = 'ptx' GROUP BY ALL", "insns")(
    lambda s, d: disasm.ptx(_listing(s, d, "ptx", F.concat(F.lit("\t"), _CODE(), F.lit(";\n\t.reg .f32 %f<3>;\n$L1:")), F.concat(F.lit(".visible .entry "), "file", F.lit("(\n\t.param .u64 p0\n)\n{\n")))).groupBy("kernel", "mnemonic", "operands").agg(F.count("*").alias("n"))
)
query("amdgcn_listing", _INSN("amdgcn"), "insns")(
    lambda s, d: disasm.amdgcn(_listing(s, d, "amdgcn", F.concat(F.lit("  "), _hex(F.col("pos")), F.lit(": "), F.when(F.col("pos") % 2 == 0, "d2820000 ").otherwise(""), _CODE()), F.concat(F.lit("<"), "file", F.lit(">:\n")))).select("kernel", "addr", "mnemonic", "operands")
)
query("objdump_listing", "SELECT kernel, pos AS addr, mnemonic, operands, CASE WHEN pos % 5 = 0 THEN 'note' ELSE '' END AS comment FROM insns WHERE arch = 'x86-64'", "insns")(
    lambda s, d: disasm.objdump(_listing(s, d, "x86-64", F.concat(F.lit("  "), _hex(F.col("pos"), 6), F.lit(":\t"), _CODE(), F.when(F.col("pos") % 5 == 0, "   # note").otherwise("")), F.concat(F.lit("0000000000401000 <"), "file", F.lit(">:\n")))).select("kernel", "addr", "mnemonic", "operands", "comment")
)
query("symbol_table", "SELECT p_partkey * 16 AS addr, CASE WHEN p_partkey % 2 = 0 THEN cast(p_size AS bigint) END AS size, 'f' || cast(p_partkey AS varchar) AS name FROM part WHERE p_partkey % 3 > 0")(
    lambda s, d: disasm.symbols(V.load(s, d, "part").select(F.concat(_hex(F.col("p_partkey") * 16, 16), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), _hex(F.col("p_size").cast("bigint"), 16))).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, " D f").when(F.col("p_partkey") % 3 == 1, " T f").otherwise(" w f"), _s("p_partkey")).alias("value")))
)
query("line_tables", "SELECT p_partkey AS addr, 'f' || cast(p_size AS varchar) || '.cu' AS file, p_size AS line FROM part")(
    lambda s, d: disasm.dwarf_lines(_text(V.load(s, d, "part"), "p_brand", F.concat(F.lit("f"), _s("p_size"), F.lit(".cu    "), _s("p_size"), F.lit("    0x"), _hex(F.col("p_partkey"), 1)), "p_partkey", "CU: a.cu:\nFile name    Line number    Starting address\n"))
)
query("listing_lines", "SELECT p_partkey AS addr, '/s/' || p_brand || '.cpp' AS file, p_size AS line FROM part UNION ALL SELECT p_partkey + 1000000, '/s/' || p_brand || '.cpp', p_size FROM part")(
    lambda s, d: disasm.listing_lines(_text(V.load(s, d, "part"), "p_brand", F.concat(F.lit("; /s/"), "p_brand", F.lit(".cpp:"), _s("p_size"), F.lit("\n  "), _hex(F.col("p_partkey")), F.lit(": v_x v0\n  "), _hex(F.col("p_partkey") + 1000000), F.lit(": v_y v1")), "p_partkey"))
)
query("ptx_lines", "SELECT p_partkey AS addr, 'k' || p_brand || '.cu' AS file, p_size AS line FROM part")(
    lambda s, d: (lambda p: disasm.ptx_lines(_text(p, "p_brand", F.concat(F.lit(".loc 1 "), _s("p_size"), F.lit(" 0\n/*"), _hex(F.col("p_partkey")), F.lit("*/ add;")), "p_partkey").select("file", F.concat(F.lit('.file 1 "k'), "file", F.lit('.cu"\n'), "value").alias("value"))))(V.load(s, d, "part"))
)
query("symbolizer_output", "WITH r AS (SELECT *, cast(row_number() OVER (ORDER BY n_nationkey) - 1 AS integer) AS pos FROM nation) SELECT '/lib' AS lib, '0x' || cast(n_nationkey AS varchar) AS \"offset\", '/src/' || n_name || '.c' AS file, n_nationkey + 1 AS line FROM r WHERE n_nationkey % 4 > 0")(
    lambda s, d: (lambda n: disasm.resolved(_text(n, "one", F.concat("n_name", F.lit("\n"), F.when(F.col("n_nationkey") % 4 == 0, "??:0").otherwise(F.concat(F.lit("/src/"), "n_name", F.lit(".c:"), (F.col("n_nationkey") + 1).cast("string")))), "n_nationkey"), "/lib", n.select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("0x"), _s("n_nationkey")).alias("addr"))))(V.load(s, d, "nation").withColumn("one", F.lit("f")))
)
query("annotated_listing", "SELECT p_partkey % 64 AS addr, max(p_size + 0.25::double) AS pct FROM part WHERE p_size % 5 > 0 GROUP BY 1")(
    lambda s, d: disasm.perf_annotate(V.load(s, d, "part").select(F.concat(F.lit("  "), F.when(F.col("p_size") % 5 == 0, "0.00").otherwise(F.concat(_s("p_size"), F.lit(".25"))), F.lit(" :  "), _hex(F.col("p_partkey") % 64, 6), F.lit(":  mov rax")).alias("value")))
)
query("pc_sample_records", "SELECT l_returnflag AS func_name, l_partkey AS pc_offset, l_linenumber AS stall_reason, cast(l_quantity AS bigint) AS count FROM lineitem")(
    lambda s, d: wire.pc_samples(wire.parse(V.load(s, d, "lineitem").select(F.concat_ws(":", F.lit("pcsa:7"), _s("l_orderkey"), "l_returnflag", _hex(F.col("l_partkey"), 1), _s("l_linenumber"), F.col("l_quantity").cast("bigint").cast("string")).alias("value"))))
)
query(
    "rv64_classes",
    "WITH t AS (SELECT * FROM (VALUES ('fence', 'sync'), ('beq', 'control'), ('vfmadd.vv', 'compute'), ('vfmacc.vv', 'vec_sp'), ('fmadd.d', 'compute'), ('vle32.v', 'vec_mem'), ('vfadd.vv', 'vec_sp'), ('vadd.vv', 'vector'), ('ld', 'memory'), ('sw', 'memory'), ('addi', 'scalar')) t(mnemonic, itype)) SELECT p_partkey, mnemonic, itype FROM part, t",
)(lambda s, d: V.load(s, d, "part").select("p_partkey", F.explode(F.array(*[F.lit(m) for m in ("fence", "beq", "vfmadd.vv", "vfmacc.vv", "fmadd.d", "vle32.v", "vfadd.vv", "vadd.vv", "ld", "sw", "addi")])).alias("mnemonic")).select("p_partkey", "mnemonic", classify.classify(F.lit("rv64"), F.col("mnemonic"), F.lit("a0, a1")).alias("itype")))

# ------------------------------------------------------------------ telemetry

_SPAN = "struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:struct<intValue:string,doubleValue:double,stringValue:string>>>>"


def _payload_spans(s: SparkSession, d: str) -> DataFrame:
    """scope and the fields of the spans in trace payloads."""
    body = F.from_json("payload", f"resourceSpans array<struct<scopeSpans:array<struct<scope:struct<name:string>,spans:array<{_SPAN}>>>>>")
    rows = otlp.traces_payload(V.spans(s, d), "app", 5, "host", 1000).select(F.explode(body["resourceSpans"][0]["scopeSpans"]).alias("sc"))
    return rows.select(F.col("sc.scope.name").alias("scope"), F.explode("sc.spans").alias("x")).select("scope", "x.*")


query("otlp_spans", "SELECT 'tracewright.' || category AS scope, left(sha256('app:5:host'), 32) AS trace_id, printf('%016x', seq) AS span_id, CASE WHEN p.span_id IS NOT NULL THEN printf('%016x', cast(s.parent_span_id AS bigint)) END AS parent_id, name, cast(start_ns + 1000 AS varchar) AS start_text, cast(start_ns + 1000 + greatest(duration_ns, 0) AS varchar) AS end_text FROM spans s LEFT JOIN (SELECT DISTINCT span_id FROM spans) p ON p.span_id = s.parent_span_id", "spans")(
    lambda s, d: _payload_spans(s, d).select("scope", F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.col("parentSpanId").alias("parent_id"), "name", F.col("startTimeUnixNano").alias("start_text"), F.col("endTimeUnixNano").alias("end_text"))
)
query("otlp_attributes", """, a AS (SELECT seq, 'category' AS key, category AS v FROM spans UNION ALL SELECT seq, 'process.pid', cast(pid AS varchar) FROM spans WHERE pid <> 0 UNION ALL SELECT seq, 'thread.id', cast(tid AS varchar) FROM spans WHERE tid <> 0
UNION ALL SELECT seq, 'tag.type', t_type FROM spans WHERE t_type IS NOT NULL UNION ALL SELECT seq, 'tag.bytes', t_bytes FROM spans WHERE t_bytes IS NOT NULL UNION ALL SELECT seq, 'tag.stream', t_stream FROM spans WHERE t_stream IS NOT NULL UNION ALL SELECT seq, 'tag.side', t_side FROM spans WHERE t_side IS NOT NULL UNION ALL SELECT seq, 'tag.grid', t_grid FROM spans WHERE t_grid IS NOT NULL UNION ALL SELECT seq, 'tag.count', t_count FROM spans WHERE t_count IS NOT NULL)
SELECT printf('%016x', seq) AS span_id, key, cast(try_cast(v AS bigint) AS varchar) AS whole, CASE WHEN try_cast(v AS bigint) IS NULL THEN v END AS text FROM a""", "spans")(
    lambda s, d: _payload_spans(s, d).select(F.col("spanId").alias("span_id"), F.explode("attributes").alias("a")).select("span_id", "a.key", F.col("a.value.intValue").alias("whole"), F.col("a.value.stringValue").alias("text"))
)
query("otlp_metrics", "SELECT name, cast(floor(seq / 1000) AS bigint) AS part, 'u' AS unit, count(*) AS points, arg_min(cast(timestamp_ns + 1000 AS varchar), seq) AS first_time, max(value) AS top FROM counters GROUP BY ALL", "counters")(
    lambda s, d: otlp.metrics(V.counters(s, d).withColumn("unit", F.when(F.col("seq") % 3 == 0, "u").otherwise("")), 1000).select("name", "part", F.from_json("payload", "unit string, gauge struct<dataPoints:array<struct<timeUnixNano:string,asDouble:double>>>").alias("m"))
    .select("name", "part", "m.unit", F.size("m.gauge.dataPoints").cast("bigint").alias("points"), F.col("m.gauge.dataPoints")[0]["timeUnixNano"].alias("first_time"), F.array_max("m.gauge.dataPoints.asDouble").alias("top"))
)

# ------------------------------------------------------------------ summaries and reports

_TIME = lambda v: f"CASE WHEN {v} >= 1e9 THEN printf('%.3fs', {v} / 1e9::double) WHEN {v} >= 1e6 THEN printf('%.2fms', {v} / 1e6::double) WHEN {v} >= 1e3 THEN printf('%.1fµs', {v} / 1e3::double) ELSE printf('%.0fns', cast({v} AS double)) END"


def _section(s: SparkSession, d: str, name: str) -> DataFrame:
    return next(rows for title, _, rows in report.sections(V.spans(s, d)) if title == name)


query("report_categories", f", g AS (SELECT category, count(*) AS n, cast(sum(duration_ns) AS double) AS t FROM spans GROUP BY 1) SELECT category, cast(n AS varchar) AS count, {_TIME('t')} AS total_ns FROM g", "spans")(lambda s, d: _section(s, d, "Categories"))
query("report_hotspots", f", g AS (SELECT name, category, count(*) AS n, cast(sum(duration_ns) AS double) AS t FROM spans GROUP BY 1, 2), a AS (SELECT sum(t) AS every_ FROM g) SELECT name, category, cast(n AS varchar) AS count, {_TIME('t')} AS total_ns, printf('%.1f %%', 100 * t / every_) AS pct FROM g, a ORDER BY t DESC, category, name LIMIT 20", "spans")(lambda s, d: _section(s, d, "Hotspots").drop("avg_ns"))


query("report_headings", "SELECT * FROM (VALUES ('# Performance report'), ('**Command:** app  '), ('## Run'), ('## Categories'), ('## Hotspots'), ('## Synchronisation'), ('## GPU'), ('## Findings')) t(line)")(
    lambda s, d: s.createDataFrame([(x,) for x in report.markdown(V.spans(s, d), about={"Command": "app"}, notes="none").split("\n") if x.startswith(("#", "**"))], "line string")
)


def _summary(s: SparkSession, d: str) -> DataFrame:
    """The lines on categories."""
    lines = summary.summary(V.spans(s, d), exact=True).split("\n")
    end = next(i for i, x in enumerate(lines) if x.startswith("Hotspots"))
    return s.createDataFrame([(x,) for x in lines[lines.index("Categories") + 1 : end]], "line string")


query("summary_lines", f", g AS (SELECT category, count(*) AS n, cast(sum(duration_ns) AS double) AS t FROM spans GROUP BY 1) SELECT '  ' || rpad(category, 12, ' ') || ' ' || lpad(format('{{:,}}', n), 10, ' ') || ' ' || lpad({_TIME('t')}, 12, ' ') AS line FROM g", "spans")(_summary)


def _flame(s: SparkSession, d: str) -> DataFrame:
    root = json.loads(summary.flame_json(V.folded(s, d)))
    rows, todo = [], [(0, root)]
    while todo:
        depth, node = todo.pop()
        rows.append((depth, node["name"], node["value"], len(node["children"])))
        todo += [(depth + 1, c) for c in node["children"]]
    return s.createDataFrame(rows, "depth int, name string, value long, children int")


query("flame_document", ", f AS (SELECT string_split(stack, ';') AS p, count FROM folded), t AS (SELECT p[1:i] AS path, count FROM (SELECT *, unnest(generate_series(0, len(p))) AS i FROM f)), n AS (SELECT path, cast(sum(count) AS bigint) AS value FROM t GROUP BY path) SELECT cast(len(x.path) AS integer) AS depth, CASE WHEN len(x.path) = 0 THEN 'all' ELSE x.path[len(x.path)] END AS name, x.value, cast((SELECT count(*) FROM n y WHERE len(y.path) = len(x.path) + 1 AND y.path[1:len(x.path)] = x.path) AS integer) AS children FROM n x", "folded")(_flame)
query("flame_self", ", f AS (SELECT string_split(stack || ';;leaf', ';') AS p, count FROM folded), t AS (SELECT p[1:i] AS path, len(p) = i AS leaf, count FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM f)) SELECT array_to_string(path, ';') AS path, cast(sum(count) AS bigint) AS value, cast(coalesce(sum(count) FILTER (leaf), 0) AS bigint) AS self FROM t GROUP BY path", "folded")(
    lambda s, d: flame.tree(V.folded(s, d).withColumn("stack", F.concat("stack", F.lit(";;leaf"))), keep_blank=True).select(F.array_join("path", ";").alias("path"), "value", "self")
)
query(
    "flame_columns",
    """, f AS (SELECT string_split(stack, ';') AS p, count FROM folded), t AS (SELECT p[1:i] AS path, count FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM f)), n AS (SELECT path, cast(sum(count) AS bigint) AS value FROM t GROUP BY path),
o AS (SELECT path, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY path[1:len(path) - 1]) AS kids, path[1:len(path) - 1] AS up FROM n WINDOW w AS (PARTITION BY path[1:len(path) - 1] ORDER BY value DESC, path[len(path)])),
a AS (SELECT sum(value) AS whole FROM n WHERE len(path) = 1),
l1 AS (SELECT path, value, r, kids, greatest(1, cast(floor(100000.0::double * value / whole) AS bigint)) AS share FROM o, a WHERE len(path) = 1),
p1 AS (SELECT path, value, coalesce(sum(share) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, share, r, kids FROM l1),
q1 AS (SELECT path, value, cast(x AS bigint) AS x, cast(CASE WHEN r = kids THEN 100000 - x ELSE share END AS bigint) AS width FROM p1),
l2 AS (SELECT o.path, o.value, r, kids, q1.x AS x0, q1.width AS w0, greatest(1, cast(floor(cast(q1.width * o.value AS double) / q1.value) AS bigint)) AS share FROM o JOIN q1 ON o.up = q1.path),
p2 AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY path[1:1] ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l2),
q2 AS (SELECT path, value, cast(x0 + before AS bigint) AS x, cast(CASE WHEN r = kids THEN w0 - before ELSE share END AS bigint) AS width FROM p2)
SELECT array_to_string(path, ';') AS path, x, width FROM q1 UNION ALL SELECT array_to_string(path, ';'), x, width FROM q2""",
    "folded",
)(lambda s, d: s.createDataFrame([(";".join(c["path"]), c["x"], c["width"]) for c in flame.columns(flame.tree(V.folded(s, d)), 100_000) if c["depth"] <= 2], "path string, x long, width long"))

# ------------------------------------------------------------------ look-ups, pending work, peaks, formats

query("frame_lookup", "SELECT c_custkey AS seq, c_name || CASE WHEN p_partkey IS NOT NULL THEN ' (' || p_brand || '.c:' || cast(p_size AS varchar) || ')' ELSE '' END || '|/lib|0x' || cast(c_custkey AS varchar) || ';main' AS frames FROM customer LEFT JOIN part ON p_partkey = c_custkey AND p_size % 2 = 0")(
    lambda s, d: joins.annotate_frames(
        V.load(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.array(F.concat("c_name", F.lit("|/lib|0x"), _s("c_custkey")), F.lit("main")).alias("stack_frames")),
        V.load(s, d, "part").where("p_size % 2 = 0").select(F.lit("/lib").alias("lib"), F.concat(F.lit("0x"), _s("p_partkey")).alias("offset"), F.concat(F.lit("/src/"), "p_brand", F.lit(".c")).alias("file"), F.col("p_size").alias("line")),
    ).select("seq", F.array_join("stack_frames", ";").alias("frames"))
)
query("pending_work", ", x AS (SELECT event_id AS seq, user_id % 3 AS pid, k % 4 AS stream, CASE event_type WHEN 'click' THEN 'launch' WHEN 'view' THEN 'launch' WHEN 'purchase' THEN 'sync' WHEN 'signup' THEN 'all' END AS kind FROM ev) SELECT a.seq, (SELECT min(b.seq) FROM x b WHERE b.seq > a.seq AND b.pid = a.pid AND (b.kind = 'all' OR (b.kind = 'sync' AND b.stream = a.stream))) AS flush_seq FROM x a WHERE kind = 'launch'", "ev")(
    lambda s, d: (lambda e: pairing.flushed(e.where("event_type in ('click', 'view')").select("pid", "stream", "seq"), e.where("event_type in ('purchase', 'signup')").select("pid", F.when(F.col("event_type") == "purchase", F.col("stream")).alias("stream"), "seq")).select("seq", "flush_seq"))(
        V.events(s, d).select(F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("pid"), (F.col("k") % 4).alias("stream"), "event_type")
    )
)
_ROCM = [("a", 110, 1.5, 1.6, 8192, "gfx90a"), ("b", 60, 1.8, 1.0, 4096, "gfx906"), ("c", 120, 1.5, 1.2, 4096, "gfx908")]
query(
    "rocm_peaks",
    f"WITH t AS (SELECT name, sm, ghz::double AS ghz, mem::double AS mem, bits, gfx FROM (VALUES {V.values(_ROCM)}) t(name, sm, ghz, mem, bits, gfx)), b AS (SELECT *, sm * CASE WHEN gfx = 'gfx90a' THEN 128 ELSE 64 END * 2 * ghz / 1000 AS fp32_tflops, 2 * mem * bits / 8 AS bandwidth_gbs FROM t) SELECT name, fp32_tflops, fp32_tflops * CASE WHEN gfx = 'gfx90a' THEN 0.5::double ELSE 0.0625::double END AS fp64_tflops, bandwidth_gbs, CASE gfx WHEN 'gfx90a' THEN 6400::double WHEN 'gfx908' THEN 1600::double ELSE 4 * bandwidth_gbs END AS l2_bandwidth_gbs FROM b",
)(lambda s, d: roofline.rocm_peaks(s.sql(f"SELECT name, sm_count, cast(core_clock_ghz as double) core_clock_ghz, cast(mem_clock_ghz as double) mem_clock_ghz, mem_bus_bits, compute_cap FROM VALUES {V.values(_ROCM)} AS t(name, sm_count, core_clock_ghz, mem_clock_ghz, mem_bus_bits, compute_cap)")).select("name", "fp32_tflops", "fp64_tflops", "bandwidth_gbs", "l2_bandwidth_gbs"))
query("cpu_peaks", "SELECT p_partkey, p_size * 3::double * CASE p_partkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 1 END * 2 / 1000 AS fp32_tflops, p_size * 3::double * CASE p_partkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 1 END * 2 / 1000 / 2 AS fp64_tflops, 200::double AS l3_bandwidth_gbs FROM part")(
    lambda s, d: roofline.cpu_peaks(V.load(s, d, "part").select("p_partkey", F.col("p_size").alias("cores"), F.lit(None).cast("double").alias("core_clock_ghz"), F.lit(None).cast("double").alias("bandwidth_gbs"), F.when(F.col("p_partkey") % 4 == 0, "sse4_1 avx AVX512F").when(F.col("p_partkey") % 4 == 1, "sse4_1 avx").when(F.col("p_partkey") % 4 == 2, "sse4_1").otherwise("").alias("flags"))).select("p_partkey", "fp32_tflops", "fp64_tflops", "l3_bandwidth_gbs")
)
query("format_flops", "SELECT o_orderkey, CASE WHEN v >= 1000 THEN printf('%.1f PF', v / 1000) WHEN v >= 1 THEN printf('%.1f TF', v) WHEN v >= 0.001 THEN printf('%.0f GF', v * 1000) ELSE printf('%.1e TF', v) END AS text FROM (SELECT o_orderkey, o_totalprice / CASE o_orderkey % 4 WHEN 0 THEN 10.37::double WHEN 1 THEN 100003::double WHEN 2 THEN 100000007::double ELSE 1000000000039::double END AS v FROM orders)")(
    lambda s, d: V.load(s, d, "orders").select("o_orderkey", formats.fmt_tflops(F.col("o_totalprice") / F.when(F.col("o_orderkey") % 4 == 0, 10.37).when(F.col("o_orderkey") % 4 == 1, 100003.0).when(F.col("o_orderkey") % 4 == 2, 100000007.0).otherwise(1000000000039.0)).alias("text"))
)
query("milliseconds", "SELECT seq, duration_ns / 1e6::double AS duration_ms FROM spans", "spans")(lambda s, d: V.spans(s, d).select("seq", formats.ms(F.col("duration_ns")).alias("duration_ms")))
query("sparklines", "WITH v AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS l FROM orders GROUP BY 1), m AS (SELECT *, list_min(l) AS lo, list_max(l) AS hi, l[greatest(len(l) - 11, 1):] AS tail FROM v) SELECT o_custkey, rpad(array_to_string(list_transform(tail, lambda x: substring('▁▂▃▄▅▆▇█', CASE WHEN hi <= lo THEN 1 ELSE cast(floor((x - lo) / (hi - lo) * 7) AS integer) + 1 END, 1)), ''), 12, ' ') AS line FROM m")(
    lambda s, d: V.load(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("l")).select("o_custkey", formats.sparkline(F.transform("l", lambda x: x["o_totalprice"])).alias("line"))
)
query("profile_context", """, w AS (SELECT max(end_ns) - min(start_ns) AS wall_ns, count(*) AS total_spans, count(DISTINCT tid) FILTER (tid <> 0) AS thread_count, cast(sum(duration_ns) AS bigint) AS aggregate_ns FROM spans), h AS (SELECT name, cast(sum(duration_ns) AS bigint) AS t FROM spans GROUP BY category, name ORDER BY t DESC, category, name LIMIT 1),
c AS (SELECT count(*) AS n FROM (SELECT category, sum(duration_ns) AS t FROM spans GROUP BY 1), w WHERE 100::double * t / w.wall_ns >= 0.1), m AS (SELECT count(*) AS n FROM spans WHERE category = 'memory'), k AS (SELECT count(DISTINCT parent_span_id) AS n FROM spans WHERE parent_span_id IN (SELECT span_id FROM spans))
SELECT wall_ns, total_spans, thread_count, aggregate_ns, h.name AS hottest, h.t AS hottest_ns, c.n AS categories, m.n AS memory_count, least(10, k.n) AS parents FROM w, h, c, m, k""", "spans")(
    lambda s, d: context.profile(V.spans(s, d)).select(F.from_json("profile", "run struct<wall_ns:bigint,total_spans:bigint,thread_count:bigint,aggregate_ns:bigint>, time_breakdown_by_category array<struct<category:string>>, top_hotspots array<struct<name:string,total_ns:bigint>>, memory array<struct<count:bigint>>, span_hierarchy_sample array<struct<parent:string>>").alias("p"))
    .select("p.run.*", F.col("p.top_hotspots")[0]["name"].alias("hottest"), F.col("p.top_hotspots")[0]["total_ns"].alias("hottest_ns"), F.size("p.time_breakdown_by_category").cast("bigint").alias("categories"), F.col("p.memory")[0]["count"].alias("memory_count"), F.size("p.span_hierarchy_sample").cast("bigint").alias("parents"))
)


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    """Tool answers as rows, and what goes wrong as error documents."""
    spans = V.spans(s, d)
    rows = [("get_mpi_communication", r["name"], r["count"], r["total_ns"], None) for r in json.loads(named.execute(spans, "get_mpi_communication"))]
    for name, args in (("no_such_tool", {}), ("get_hotspots", {"bad": 1})):
        rows.append((name, None, None, None, json.loads(named.execute(spans, name, args))["error"].split(":")[0]))
    return s.createDataFrame(rows, "tool string, name string, count long, total_ns long, error string")


query("tool_envelopes", "SELECT 'get_mpi_communication' AS tool, name, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, NULL AS error FROM spans WHERE category = 'mpi' GROUP BY name UNION ALL SELECT 'no_such_tool', NULL, NULL, NULL, 'Unknown tool' UNION ALL SELECT 'get_hotspots', NULL, NULL, NULL, 'Bad arguments for get_hotspots'", "spans")(_envelopes)
