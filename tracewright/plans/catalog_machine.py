"""Instructions, hints, rooflines and formats."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import formats as X
from ..functions import names as N
from ..operators import insns, roofline
from ..sinks import summary
from . import views as V
from .catalog import query


def _re(column: str, pattern: str, fold: bool = True) -> str:
    return f"regexp_matches({column}, '{'(?i)' if fold else ''}{pattern}')"


def _class_sql() -> str:
    """The classes of the views' instructions, written out for DuckDB."""
    x, a, s, p, m, o = C.X86, C.AARCH64, C.SASS, C.PTX, "mnemonic", "operands"
    x86 = f"""CASE WHEN {_re(m, x['sync'])} THEN 'sync' WHEN {_re(m, x['control'])} THEN 'control' WHEN {_re(m, x['compute'])} THEN 'compute'
  WHEN {_re(o, x['wide_operand'])} OR ({_re(m, x['vector'])} AND lower(mnemonic) NOT IN ('vzeroupper', 'vzeroall')) OR {_re(o, x['xmm_operand'])}
    THEN CASE WHEN {_re(m, x['vec_mem'])} THEN 'vec_mem' WHEN {_re(m, x['vec_sp'])} THEN 'vec_sp' WHEN {_re(m, x['vec_dp'])} THEN 'vec_dp' ELSE 'vector' END
  WHEN contains(operands, '[') AND {_re(m, x['memory'])} THEN 'memory' ELSE 'scalar' END"""
    sass = "CASE " + " ".join(f"WHEN {_re('upper(mnemonic)', s[k], False)} THEN '{k}'" for k in ("memory", "sync", "control", "compute")) + " ELSE 'scalar' END"
    ptx = "CASE " + " ".join(f"WHEN {_re(m, p[k])} THEN '{k}'" for k in ("vector", "sync", "control", "memory", "compute")) + " ELSE 'scalar' END"
    gcn = """CASE WHEN starts_with(mnemonic, 'v_') THEN CASE WHEN contains(mnemonic, '_f32') OR contains(mnemonic, '_f16') OR contains(mnemonic, '_bf16') OR contains(mnemonic, '_f8') THEN 'vec_sp' WHEN contains(mnemonic, '_f64') THEN 'vec_dp' ELSE 'vector' END
  WHEN starts_with(mnemonic, 's_') THEN CASE WHEN contains(mnemonic, 'branch') OR mnemonic = 's_endpgm' THEN 'control' WHEN contains(mnemonic, 'waitcnt') OR contains(mnemonic, 'barrier') THEN 'sync' ELSE 'scalar' END
  WHEN regexp_matches(mnemonic, '^(ds_|flat_|global_|buffer_|scratch_)') THEN 'memory' ELSE 'other' END"""
    a64 = f"""CASE {' '.join(f"WHEN {_re(m, a[k])} THEN '{k}'" for k in ('sync', 'control', 'compute'))} WHEN {_re(o, a['simd_operand'])} OR {_re(m, a['simd'])}
    THEN CASE WHEN {_re(m, a['vec_mem'])} THEN 'vec_mem' WHEN {_re(o, a['vec_dp'])} THEN 'vec_dp' WHEN {_re(o, a['vec_sp'])} THEN 'vec_sp' ELSE 'vector' END WHEN {_re(m, a['memory'])} THEN 'memory' ELSE 'scalar' END"""
    return f", c AS (SELECT *, CASE arch WHEN 'x86-64' THEN {x86} WHEN 'sass' THEN {sass} WHEN 'ptx' THEN {ptx} WHEN 'amdgcn' THEN {gcn} ELSE {a64} END AS itype FROM insns)"


_C = _class_sql()
query("instruction_classes", _C + " SELECT kernel, pos, itype FROM c", "insns")(lambda s, d: V.instructions(s, d).select("kernel", "pos", "itype"))
query("instruction_mix", _C + " SELECT kernel, itype, count(*) AS n, cast(100 AS double) * count(*) / cast(sum(count(*)) OVER (PARTITION BY kernel) AS bigint) AS pct FROM c WHERE itype <> 'other' GROUP BY kernel, itype", "insns")(lambda s, d: insns.mix(V.instructions(s, d)))
query("instruction_totals", "SELECT kernel, count(*) AS n FROM insns GROUP BY kernel", "insns")(lambda s, d: insns.totals(V.instructions(s, d)))

_P = lambda k: f"cast(100 AS double) * {k} / n"
_MEASURES = _C + """, m AS (SELECT kernel, arch, count(*) AS n, count(*) FILTER (itype IN ('vec_sp', 'vec_dp', 'vec_mem', 'vector')) AS vec, count(*) FILTER (itype = 'compute') AS compute, count(*) FILTER (itype = 'memory') AS memory, count(*) FILTER (itype = 'control') AS control,
  count(*) FILTER (contains(operands, '[rsp') OR contains(operands, '[rbp')) AS spill, count(*) FILTER (lower(mnemonic) IN ('mulss','addss','subss','mulsd','addsd','subsd','mulps','addps','subps','mulpd','addpd','subpd')) AS unfused,
  count(*) FILTER (contains(lower(operands), 'ymm') OR contains(lower(operands), 'zmm')) AS wide, count(*) FILTER (contains(lower(operands), 'xmm')) AS xmm, count(*) FILTER (starts_with(lower(mnemonic), 'call')) AS calls,
  count(*) FILTER (regexp_matches(upper(mnemonic), '^(LDG|STG)\\b')) AS s_global, count(*) FILTER (regexp_matches(upper(mnemonic), '^(LDS|STS|LDGSTS)\\b')) AS s_shared, count(*) FILTER (regexp_matches(upper(mnemonic), '^(FFMA|DFMA|HMMA|BMMA|IMAD|HFMA|FMUL|FADD|DMUL|DADD)\\b')) AS s_compute,
  count(*) FILTER (regexp_matches(upper(mnemonic), '^BAR\\b')) AS s_bar, count(*) FILTER (regexp_matches(upper(mnemonic), '^(ATOM|RED)\\b')) AS s_atom, count(*) FILTER (regexp_matches(upper(mnemonic), '^LDGSTS\\b')) AS s_async, count(*) FILTER (regexp_matches(upper(mnemonic), '^HFMA\\b')) AS s_hfma,
  count(*) FILTER (regexp_matches(upper(mnemonic), '^HMMA\\b')) AS s_hmma, count(*) FILTER (stall_cycles >= 10) AS s_stall, count(*) FILTER ((starts_with(mnemonic, 'ld') OR starts_with(mnemonic, 'st')) AND contains(operands || mnemonic, '.global')) AS p_global, count(*) FILTER (contains(operands || mnemonic, '.shared')) AS p_shared,
  count(*) FILTER (mnemonic IN ('atom', 'red')) AS p_atom, count(*) FILTER (mnemonic = 'bar') AS p_bar, count(*) FILTER (contains(mnemonic, '.v2') OR contains(mnemonic, '.v4') OR contains(operands, '.v2') OR contains(operands, '.v4')) AS p_vec,
  count(*) FILTER (starts_with(mnemonic, 'v_')) AS a_valu, count(*) FILTER (starts_with(mnemonic, 'ds_')) AS a_lds, count(*) FILTER (regexp_matches(mnemonic, '^(buffer_|global_|flat_)')) AS a_global, count(*) FILTER (contains(mnemonic, 'waitcnt')) AS a_wait FROM c GROUP BY kernel, arch)"""
_RULES = {
    "low_vectorisation": ("cpu", "warn", "vectorize", f"{_P('vec')} < 10 AND n >= 20"), "memory_heavy": ("cpu", "warn", "memory", f"{_P('memory')} > 35"), "register_spills": ("cpu", "warn", "register", f"{_P('spill')} > 8"),
    "unfused_fp": ("cpu", "info", "compute", f"unfused > 0 AND {_P('compute')} < 3 AND n >= 15"), "narrow_simd": ("cpu", "info", "vectorize", "xmm > 0 AND wide = 0 AND n >= 20"),
    "frequent_calls": ("cpu", "info", "branch", f"{_P('control')} > 15 AND n >= 20 AND calls > 3"), "branch_density": ("cpu", "info", "branch", f"{_P('control')} > 15 AND n >= 20 AND calls <= 3"),
    "s_global_without_shared": ("sass", "crit", "memory", f"{_P('s_global')} > 20 AND s_shared < 3 AND n >= 15"), "s_low_compute": ("sass", "warn", "compute", f"{_P('s_compute')} < 15 AND n >= 20"), "s_high_stalls": ("sass", "warn", "memory", f"{_P('s_stall')} > 20"),
    "s_barriers": ("sass", "warn", "sync", f"{_P('s_bar')} > 4"), "s_atomics": ("sass", "info", "compute", f"{_P('s_atom')} > 5"), "s_half_without_tensor": ("sass", "info", "compute", "s_hfma > 0 AND s_hmma = 0"), "s_no_async_copy": ("sass", "info", "memory", "s_global > 5 AND s_async = 0 AND n >= 30"),
    "p_global_without_shared": ("ptx", "warn", "memory", f"{_P('p_global')} > 20 AND p_shared < 3 AND n >= 15"), "p_atomics": ("ptx", "info", "compute", f"{_P('p_atom')} > 5"), "p_barriers": ("ptx", "info", "sync", f"{_P('p_bar')} > 3"),
    "p_no_vector_loads": ("ptx", "info", "memory", f"{_P('p_vec')} < 5 AND p_global > 5 AND n >= 20"), "a_low_valu": ("amdgcn", "warn", "compute", f"{_P('a_valu')} < 30 AND n >= 20"), "a_global_without_lds": ("amdgcn", "crit", "memory", f"{_P('a_global')} > 20 AND a_lds < 5 AND n >= 15"), "a_waits": ("amdgcn", "warn", "memory", f"{_P('a_wait')} > 5"),
}
_GROUP = "CASE arch WHEN 'x86-64' THEN 'cpu' WHEN 'aarch64' THEN 'cpu' ELSE arch END"
query(
    "asm_advice",
    _MEASURES + " " + " UNION ALL ".join(f"SELECT kernel, '{r.removeprefix('s_').removeprefix('p_').removeprefix('a_')}' AS rule, '{sev}' AS severity, '{cat}' AS category FROM m WHERE {_GROUP} = '{g}' AND n >= {8 if g == 'cpu' else 5} AND {when}" for r, (g, sev, cat, when) in _RULES.items()),
    "insns",
)(lambda s, d: insns.advise(V.instructions(s, d)).drop("message"))
query("asm_measures", _MEASURES + " SELECT * FROM m", "insns")(lambda s, d: insns.measures(V.instructions(s, d)))
query("processor_hints", "SELECT name, value, CASE name WHEN 'ipc' THEN CASE WHEN value >= 3 THEN 'excellent' WHEN value >= 2 THEN 'good' WHEN value >= 1 THEN 'moderate' ELSE 'low' END WHEN 'cache_miss_pct' THEN CASE WHEN value < 5 THEN 'good' WHEN value < 20 THEN 'moderate' ELSE 'high' END ELSE CASE WHEN value < 1 THEN 'good' WHEN value < 5 THEN 'moderate' ELSE 'high' END END AS verdict FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'ipc' WHEN 1 THEN 'cache_miss_pct' ELSE 'branch_miss_pct' END AS name, value FROM events)")(
    lambda s, d: insns.processor_hints(V.load(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, "ipc").when(F.col("event_id") % 3 == 1, "cache_miss_pct").otherwise("branch_miss_pct").alias("name"), "value"))
)

# ------------------------------------------------------------------ rooflines

_gpu = lambda s: V.devices(s).where("device_idx = 0")
_DEV = "(SELECT cast(19.5 AS double) AS peak, cast(1555.0 AS double) AS bw, cast(1.41 AS double) AS ghz, 108 AS sms, cast(19.5 AS double) * 1e12::double / (cast(1555.0 AS double) * 1e9::double) AS ridge)"
_ROOF = f""", t AS (SELECT k.*, d.*, CASE WHEN duration_ns > 0 THEN duration_ns WHEN sm_cycles_max > 0 THEN cast(trunc(sm_cycles_max / (ghz * 1e9::double) * 1e9::double) AS bigint) ELSE cast(trunc(sm_cycles_elapsed / (sms * (ghz * 1e9::double)) * 1e9::double) AS bigint) END AS dur FROM kernels k, {_DEV} d),
f AS (SELECT *, fp32_ops + fp64_ops + fp16_ops * 0.5::double AS flops, greatest(dram_bytes, 0.0::double) AS bytes, dur / 1e9::double AS secs FROM t WHERE dur > 0),
r AS (SELECT *, CASE WHEN bytes > 0 THEN flops / bytes ELSE 'inf'::double END AS ai, flops / secs / 1e12::double AS achieved_tflops, bytes / secs / 1e9::double AS achieved_gbs FROM f)"""
query(
    "counter_roofline",
    _ROOF + """ SELECT kernel_name, dur AS duration_ns, flops, bytes, ai, achieved_tflops, achieved_gbs, least(100 * achieved_tflops / peak, 999.0::double) AS flops_pct, least(100 * achieved_gbs / bw, 999.0::double) AS bw_pct, CASE WHEN bytes = 0 OR ai >= ridge THEN 'compute' ELSE 'memory' END AS bound, ridge,
  CASE source WHEN 'ncu' THEN 'hw_counters(ncu)' WHEN 'perf_llcproxy' THEN 'hw_counters(LLC proxy — write traffic missing)' ELSE 'hardware_counters' END AS data_source, fp64_ops / flops AS fp64_fraction, fp16_ops * 0.5::double / flops AS fp16_fraction, flops / l2_bytes AS l2_ai, 0.0::double AS l1_ai, 0.0::double AS l3_ai, occupancy_pct, ipc FROM r""",
    "kernels",
)(lambda s, d: roofline.from_counters(V.kernels(s, d), _gpu(s)))
_metrics = lambda s, d: roofline.from_counters(V.kernels(s, d), _gpu(s))
query("headroom", _ROOF + " SELECT kernel_name, least(ai * bw / 1000, peak) AS ceiling_tflops, least(ai * bw / 1000, peak) / achieved_tflops AS headroom FROM r", "kernels")(lambda s, d: roofline.headroom(_metrics(s, d), _gpu(s)).select("kernel_name", "ceiling_tflops", "headroom"))
query("plottable", _ROOF + " SELECT count(*) AS n FROM r WHERE achieved_tflops > 0 AND ai > 0", "kernels")(lambda s, d: roofline.plottable(_metrics(s, d)).agg(F.count("*").alias("n")))
query(
    "axis_ranges",
    _ROOF + """, q AS (SELECT min(ai) AS lo, max(ai) AS hi, min(achieved_tflops) AS tp, max(ridge) AS r, max(peak) AS peak FROM r), z AS (SELECT log10(greatest(least(lo / 5, r / 50), 1e-5::double)) AS x_lo, log10(greatest(hi, r) * 10) AS x_hi, log10(greatest(tp / 5, 1e-9::double)) AS y_lo, log10(peak * 3) AS y_hi FROM q)
SELECT x_lo, greatest(x_hi, x_lo + 2) AS x_hi, least(y_lo, y_hi - 2) AS y_lo, y_hi FROM z""",
    "kernels",
)(lambda s, d: roofline.axis_ranges(_metrics(s, d), _gpu(s)))
_POINTS = " SELECT kernel_name AS kernel, CASE WHEN bytes = 0 OR ai >= ridge THEN 'compute' ELSE 'memory' END AS bound, greatest(CASE WHEN ai < 1e9::double THEN ai ELSE ridge * 100 END, 1e-3::double) AS x, greatest(CASE WHEN ai < ridge AND ai > 0 THEN least(achieved_tflops, ai * bw / 1000) ELSE achieved_tflops END, 1e-3::double) AS y, greatest(10.0::double, 8 + 4 * log10(greatest(dur, 1) / 1e6::double)) AS size, flops > 0 AS measured FROM r"
query("roofline_points", _ROOF + _POINTS, "kernels")(lambda s, d: roofline.points(_metrics(s, d), _gpu(s)))
query("roofline_document", _ROOF + _POINTS, "kernels")(
    lambda s, d: s.createDataFrame([(p["kernel"], p["bound"], p["x"], p["y"], p["size"], p["measured"]) for p in json.loads(summary.roofline_json(_metrics(s, d), _gpu(s)))["points"]], "kernel string, bound string, x double, y double, size double, measured boolean")
)
query(
    "roofline_raster",
    _ROOF + f""", q AS (SELECT min(ai) AS lo, max(ai) AS hi, min(achieved_tflops) AS tp, max(ridge) AS r, max(peak) AS peak FROM r), z AS (SELECT log10(greatest(least(lo / 5, r / 50), 1e-5::double)) AS x_lo, log10(greatest(hi, r) * 10) AS x_hi0, log10(greatest(tp / 5, 1e-9::double)) AS y_lo0, log10(peak * 3) AS y_hi FROM q),
a AS (SELECT x_lo, greatest(x_hi0, x_lo + 2) AS x_hi, least(y_lo0, y_hi - 2) AS y_lo, y_hi FROM z), p AS ({_POINTS}), c AS (SELECT chr(cast(64 + row_number() OVER (ORDER BY kernel) AS integer)) AS letter, cast(round((log10(x) - x_lo) / (x_hi - x_lo) * 59) AS integer) AS col, 15 - cast(round((log10(greatest(y, 1e-12::double)) - y_lo) / (y_hi - y_lo) * 15) AS integer) AS line FROM p, a)
SELECT line, col, max(letter) AS letter FROM c WHERE line BETWEEN 0 AND 15 AND col BETWEEN 0 AND 59 GROUP BY line, col""",
    "kernels",
)(lambda s, d: s.createDataFrame([(r, c, x) for r, line in enumerate(roofline.raster(_metrics(s, d), _gpu(s))) for c, x in enumerate(line) if x.isalpha()], "line int, col int, letter string"))
query(
    "roofline_ceilings",
    """WITH d AS (SELECT 19.5::double AS peak, 1555.0::double AS bw, 6144.0::double AS l2, 9.7::double AS f64, 78.0::double AS f16, 312.0::double AS tc), r AS (SELECT *, peak * 1e12::double / (bw * 1e9::double) AS r, peak * 1e12::double / (l2 * 1e9::double) AS r2, f64 * 1e12::double / (bw * 1e9::double) AS r64, f16 * 1e12::double / (bw * 1e9::double) AS r16, tc * 1e12::double / (bw * 1e9::double) AS rt FROM d)
SELECT 'dram' AS line, 1e-3::double AS x0, r AS x1, 1e-3::double * bw / 1000 AS y0, r * bw / 1000 AS y1 FROM r UNION ALL SELECT 'fp32', least(r, r2), 1e5::double, peak, peak FROM r UNION ALL SELECT 'l2', 1e-3::double, r2, 1e-3::double * l2 / 1000, r2 * l2 / 1000 FROM r
UNION ALL SELECT 'fp64', r64, 1e5::double, f64, f64 FROM r UNION ALL SELECT 'fp64_slope', 1e-3::double, r64, 1e-3::double * bw / 1000, r64 * bw / 1000 FROM r UNION ALL SELECT 'fp16', r16, 1e5::double, f16, f16 FROM r UNION ALL SELECT 'tensor', rt, 1e5::double, tc, tc FROM r""",
)(lambda s, d: roofline.ceilings(_gpu(s)))
_FLOPS = [(a, t, v) for a, ts in roofline.FLOPS.items() for t, v in ts.items()]
query(
    "static_kernels",
    _C + f""", fl AS (SELECT * FROM (VALUES {V.values(_FLOPS)}) t(a, t, v)) SELECT kernel, arch, sum(coalesce(v, 0))::double AS flops_per_thread, sum(CASE WHEN itype = 'memory' THEN 8.0::double ELSE 0 END) AS bytes_per_thread FROM c LEFT JOIN fl ON t = itype AND a = CASE arch WHEN 'x86-64' THEN 'x86' ELSE arch END GROUP BY kernel, arch""",
    "insns",
)(lambda s, d: roofline.static_kernels(V.instructions(s, d)))
query(
    "static_roofline",
    _C + f""", fl AS (SELECT * FROM (VALUES {V.values(_FLOPS)}) t(a, t, v)), k AS (SELECT kernel, arch, sum(coalesce(v, 0))::double AS f, sum(CASE WHEN itype = 'memory' THEN 8.0::double ELSE 0 END) AS b FROM c LEFT JOIN fl ON t = itype AND a = CASE arch WHEN 'x86-64' THEN 'x86' ELSE arch END GROUP BY kernel, arch),
s AS (SELECT l_returnflag, p_brand AS name, cast(l_quantity AS bigint) * 1000 AS duration_ns, 1 + l_linenumber AS threads, row_number() OVER (PARTITION BY p_brand ORDER BY cast(l_quantity AS bigint) DESC, l_orderkey * 8 + l_linenumber, l_linenumber DESC) AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (SELECT k.kernel, arch, 0 AS device_idx, duration_ns, cast(threads AS bigint) AS threads, f * threads AS flops, b * threads AS bytes, duration_ns / 1e9::double AS secs, 19.5::double * 1e12::double / (1555.0::double * 1e9::double) AS ridge FROM k JOIN s ON s.name = k.kernel AND w = 1),
a AS (SELECT *, CASE WHEN bytes > 0 THEN flops / bytes ELSE 'inf'::double END AS ai FROM j)
SELECT kernel, arch, device_idx, duration_ns, threads, flops, bytes, ai, flops / secs / 1e12::double AS achieved_tflops, bytes / secs / 1e9::double AS achieved_gbs, CASE WHEN bytes = 0 OR ai >= ridge THEN 'compute' ELSE 'memory' END AS bound, ridge FROM a""",
    "insns",
)(
    lambda s, d: roofline.static_roofline(
        V.load(s, d, "lineitem").join(V.load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("name"), F.lit("cuda").alias("category"), (F.col("l_quantity").cast("bigint") * 1000).alias("duration_ns"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            F.create_map(F.lit("count"), (1 + F.col("l_linenumber")).cast("string")).alias("tags")),
        V.instructions(s, d), V.devices(s))
)
query("kernels_by_device", "WITH d AS (SELECT cast(p_size % 2 AS integer) AS device_idx, p_retailprice AS t FROM part) SELECT device_idx, count(*) AS kernels, max(t) AS best_tflops FROM d GROUP BY 1")(
    lambda s, d: roofline.by_device(V.load(s, d, "part").select((F.col("p_size") % 2).alias("device_idx"), F.col("p_retailprice").alias("achieved_tflops")))
)
_ATTR = [("A", 108, 1.41, 1.215, 5120, "8.0"), ("B", 80, 1.53, 0.877, 4096, "7.0"), ("C", 46, 1.71, 7.0, 256, "7.5"), ("D", 10, 1.0, 1.0, 64, "8.1"), ("E", 10, 1.0, 1.0, 64, "2.1")]
_ATTR_SQL = f"SELECT * FROM VALUES {V.values(_ATTR)} AS t(name, sm_count, core_clock_ghz, mem_clock_ghz, mem_bus_bits, compute_cap)"
_attr = lambda s, text: s.sql(f"SELECT name, sm_count, cast(core_clock_ghz AS double) AS core_clock_ghz, cast(mem_clock_ghz AS double) AS mem_clock_ghz, mem_bus_bits, compute_cap FROM ({text})")
query(
    "cuda_peaks",
    f"""WITH t AS (SELECT * FROM (VALUES {V.values(_ATTR)}) t(name, sm, ghz0, mem0, bits, cc)), a AS (SELECT *, ghz0::double AS ghz, mem0::double AS mem FROM t),
b AS (SELECT *, sm * CASE cc WHEN '8.0' THEN 64 WHEN '8.1' THEN 64 WHEN '7.0' THEN 64 WHEN '7.5' THEN 64 ELSE 64 END * 2 * ghz / 1000 AS fp32_tflops, 2 * mem * bits / 8 AS bandwidth_gbs FROM a)
SELECT name, fp32_tflops, bandwidth_gbs, fp32_tflops * CASE cc WHEN '8.0' THEN 0.5::double WHEN '8.1' THEN 0.5::double WHEN '7.0' THEN 0.5::double ELSE 1 / 32::double END AS fp64_tflops, fp32_tflops * 2 AS fp16_tflops, CASE WHEN cc = '7.0' THEN sm * 8 * 64 * ghz / 1000 WHEN cc >= '8' THEN fp32_tflops * 4 ELSE 0 END AS tensor_tflops,
  CASE cc WHEN '8.0' THEN 6144::double WHEN '8.1' THEN 6144::double WHEN '7.0' THEN 3072::double WHEN '7.5' THEN 1700::double ELSE 4 * bandwidth_gbs END AS l2_bandwidth_gbs, fp32_tflops * 1e12::double / (bandwidth_gbs * 1e9::double) AS ridge FROM b""",
)(lambda s, d: roofline.cuda_peaks(_attr(s, _ATTR_SQL)).select("name", "fp32_tflops", "bandwidth_gbs", "fp64_tflops", "fp16_tflops", "tensor_tflops", "l2_bandwidth_gbs", "ridge"))

# ------------------------------------------------------------------ formats

query(
    "format_ns",
    "SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.3fs', v / 1e9::double) WHEN v >= 1e6 THEN printf('%.2fms', v / 1e6::double) WHEN v >= 1e3 THEN printf('%.1fµs', v / 1e3::double) ELSE printf('%.0fns', v) END AS text FROM (SELECT o_orderkey, cast(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1048576 WHEN 1 THEN o_orderkey * 1024 + 1000000 WHEN 2 THEN o_orderkey * 8 + 1000 ELSE o_orderkey % 1000 END AS double) AS v FROM orders)",
)(
    lambda s, d: V.load(s, d, "orders").select(
        "o_orderkey", X.fmt_ns(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") * 1048576).when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") * 1024 + 1000000).when(F.col("o_orderkey") % 4 == 2, F.col("o_orderkey") * 8 + 1000).otherwise(F.col("o_orderkey") % 1000)).alias("text"))
)
query("colour_index", "SELECT p_partkey, cast(cast(('0x' || left(md5(p_name || cast(p_partkey AS varchar)), 8)) AS bigint) % 16 AS integer) AS colour FROM part")(lambda s, d: V.load(s, d, "part").select("p_partkey", N.colour_index(F.concat("p_name", F.col("p_partkey").cast("string")), 16).alias("colour")))
query("metric_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' [' || p_type || ']'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")(lambda s, d: V.load(s, d, "part").select("p_partkey", X.snake(F.concat("p_name", F.lit(" ["), "p_type", F.lit("]"))).alias("name")))
query("dim3_volume", "SELECT p_partkey, (1 + p_size % 7) * (1 + p_size % 3) * 2 AS threads FROM (SELECT p_partkey, cast(p_size AS bigint) AS p_size FROM part)")(
    lambda s, d: V.load(s, d, "part").select("p_partkey", N.threads(F.create_map(F.lit("grid"), F.concat((1 + F.col("p_size") % 7).cast("string"), F.lit("x"), (1 + F.col("p_size") % 3).cast("string"), F.lit("xQ")), F.lit("block"), F.lit("2"))).alias("threads"))
)
query("short_kernel_names", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END AS name FROM part")(
    lambda s, d: V.load(s, d, "part").select("p_partkey", N.short_kernel(F.concat(F.lit("_Z18kZZ"), F.length("p_name").cast("string"), "p_name", F.lit("PfiE"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("$_"), F.col("p_size").cast("string"))).otherwise(""))).alias("name"))
)
query("bars", "SELECT l_orderkey, l_linenumber, repeat('█', cast(floor(l_discount * 20) AS integer)) || repeat('░', 20 - cast(floor(l_discount * 20) AS integer)) AS bar FROM lineitem")(lambda s, d: V.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.bar(F.col("l_discount")).alias("bar")))
query("stall_nibble", "SELECT p_partkey, cast((p_partkey * 977 >> 8) & 15 AS integer) AS stall FROM part")(lambda s, d: V.load(s, d, "part").select("p_partkey", C.sass_stall(F.concat(F.lit("0x000fc400"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 977)), 8, "0"))).alias("stall")))
