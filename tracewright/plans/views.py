"""The driver's tables seen as traces, in Spark and, with the same text, in DuckDB.

``events`` becomes spans and counters, ``lineitem``/``orders`` children and
parents, ``customer``/``nation``/``region`` call stacks, ``part`` instructions,
``lineitem`` with ``part`` kernel counters.  Only a few functions differ
between the dialects; they are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"k": "cast(get_json_object(props, '$.k') as bigint)", "us": "unix_micros(cast(ts as timestamp))", "day": "unix_micros(cast(o_orderdate as timestamp))", "ship": "unix_micros(cast(l_shipdate as timestamp))", "str": "string", "div": "div", "elt": "elt", "lst": ""}
DUCK = {"k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "us": "epoch_us(ts)", "day": "epoch_us(o_orderdate)", "ship": "epoch_us(l_shipdate)", "str": "VARCHAR", "div": "//", "elt": "elt", "lst": ""}

# One row for each event: 0 click, 1 view, 2 purchase, 3 signup, 4 error.
_EVENTS = "SELECT event_id, user_id, event_type, value, {k} AS k, {us} AS us FROM events"
_SPANS = """
SELECT event_id AS seq,
  CASE event_type WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'cudaDeviceSynchronize' WHEN 1 THEN 'cudaStreamSynchronize' WHEN 2 THEN 'clFinish' ELSE 'MPI_Barrier_wait' END
    WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'MPI_Isend' WHEN 1 THEN 'MPI_Wait' WHEN 2 THEN 'MPI_Allreduce' ELSE 'MPI_Bcast' END
    WHEN 'click' THEN concat('kernel_', cast(k % 20 AS {str})) WHEN 'view' THEN concat('copy_', cast(k % 5 AS {str})) ELSE concat('loop_', cast(k % 10 AS {str})) END AS name,
  CASE event_type WHEN 'click' THEN 'cuda' WHEN 'view' THEN 'memory' WHEN 'purchase' THEN 'sync' WHEN 'signup' THEN 'mpi' ELSE 'openmp' END AS category,
  us * 1000 AS start_ns, cast(floor(value * 1000000000 + 0.5) AS bigint) AS duration_ns, us * 1000 + cast(floor(value * 1000000000 + 0.5) AS bigint) AS end_ns,
  cast(user_id % 3 AS bigint) AS pid, cast(user_id % 7 AS bigint) AS tid,
  CASE event_type WHEN 'click' THEN CASE WHEN k % 4 = 3 THEN 'memcpy' ELSE 'kernel' END WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'memcpy_async' WHEN 1 THEN 'alloc' WHEN 2 THEN 'free' ELSE 'HtoD' END
    WHEN 'purchase' THEN 'sync' WHEN 'signup' THEN NULL ELSE 'work' END AS t_type,
  CASE WHEN event_type IN ('view', 'signup') THEN cast(k * 64 AS {str}) END AS t_bytes,
  CASE WHEN event_type = 'click' AND k % 3 > 0 THEN cast(k % 4 AS {str}) END AS t_stream,
  CASE WHEN event_type = 'click' AND k % 11 = 0 THEN 'cpu' END AS t_side,
  CASE WHEN event_type = 'click' THEN concat(cast(1 + k % 8 AS {str}), 'x2x1') END AS t_grid,
  CASE WHEN event_type = 'error' THEN cast(k AS {str}) END AS t_count,
  cast(event_id AS {str}) AS span_id, CASE WHEN k % 3 = 0 AND event_id > 10 THEN cast(event_id - 1 - k % 5 AS {str}) END AS parent_span_id
FROM ev
"""
_COUNTERS = "SELECT event_id AS seq, concat(event_type, CASE WHEN k % 5 = 0 THEN '' ELSE concat('[gpu', cast(k % 3 AS {str}), ']') END) AS name, us * 1000 AS timestamp_ns, value FROM ev"
_NESTED = """
SELECT 'parent' AS kind, o_orderkey AS id, cast(NULL AS bigint) AS parent, o_orderpriority AS name, o_orderstatus AS category, {day} * 1000 AS start_ns, cast(o_totalprice * 1000 AS bigint) AS duration_ns FROM orders
UNION ALL
SELECT 'child', NULL, l_orderkey, concat(l_returnflag, l_linestatus), 'item', {ship} * 1000, cast(l_quantity AS bigint) * 1000000 FROM lineitem
"""
_STACKS = """
SELECT concat(r_name, ';', n_name, ';', c_mktsegment) AS stack, count(*) AS count
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, c_mktsegment
"""
_INSNS = """
SELECT p_brand AS kernel, cast(p_partkey AS bigint) AS pos,
  CASE cast(substring(p_brand, 7) AS int) % 5 WHEN 0 THEN 'x86-64' WHEN 1 THEN 'sass' WHEN 2 THEN 'ptx' WHEN 3 THEN 'amdgcn' ELSE 'aarch64' END AS arch, p_size AS z, cast(p_partkey % 16 AS int) AS stall_cycles
FROM part
"""
# Instructions for the part table, by architecture and p_size % 12.
TOKENS = {
    "x86-64": [("vaddps", "ymm0, ymm1, ymm2"), ("mov", "rax, [rbx]"), ("jne", "10"), ("vfmadd231pd", "ymm0, ymm1, ymm2"), ("mulss", "xmm0, xmm1"), ("mov", "[rsp+8], rax"), ("call", "f"), ("add", "rax, 1"), ("mfence", ""), ("vmovaps", "ymm0, [rax]"), ("vpxor", "xmm1, xmm2"), ("vaddsd", "xmm0, xmm1")],
    "sass": [("LDG.E", "R0, [R2]"), ("FFMA", "R0, R1, R2, R3"), ("BAR.SYNC", "0"), ("BRA", "`(.L_1)"), ("STG.E", "[R2], R0"), ("IADD3", "R0, R1, R2"), ("HFMA2", "R0, R1"), ("ATOM.ADD", "[R2], R1"), ("LDS", "R0, [R1]"), ("MOV", "R0, R1"), ("EXIT", ""), ("HFMA", "R0, R1, R2")],
    "ptx": [("ld.global.f32", "%f1, [%rd1]"), ("st.global.f32", "[%rd1], %f1"), ("fma.rn.f32", "%f1, %f2, %f3"), ("bar.sync", "0"), ("setp.lt.s32", "%p1, %r1"), ("bra", "L1"), ("add.f32", "%f1, %f2"), ("ld.global.v4.f32", "{%f1}"), ("mov.u32", "%r1, %r2"), ("atom.global.add", "%r1"), ("ret", ""), ("cvt.f32.s32", "%f1, %r1")],
    "amdgcn": [("v_fma_f32", "v0, v1"), ("s_waitcnt", "vmcnt(0)"), ("global_load_dword", "v0, v[0:1]"), ("v_add_f64", "v[0:1]"), ("s_cbranch_scc0", "1"), ("ds_read_b32", "v0, v1"), ("v_add_u32", "v0, v1"), ("s_mov_b32", "s0, s1"), ("buffer_store_dword", "v0"), ("s_endpgm", ""), ("s_barrier", ""), ("exp", "x")],
    "aarch64": [("fmla", "v0.4s, v1.4s, v2.4s"), ("ldr", "x0, [x1]"), ("b.ne", "1"), ("fmadd", "s0, s1, s2, s3"), ("add", "x0, x1, x2"), ("ld1", "{v0.2d}, [x1]"), ("dmb", "ish"), ("fadd", "v0.2d, v1.2d, v2.2d"), ("stp", "x0, x1, [sp]"), ("zip1", "v0.16b"), ("bl", "f"), ("mul", "x0, x1, x2")],
}
_KERNELS = """
SELECT p_brand AS kernel_name, sum(l_extendedprice) AS fp32_ops, sum(l_quantity) AS fp64_ops, sum(l_tax) AS fp16_ops, sum(l_quantity) * 64 AS dram_bytes, cast(count(*) * 1000 AS double) AS l2_bytes, cast(0 AS double) AS l1_bytes,
  CASE WHEN cast(substring(p_brand, 7) AS int) % 4 = 0 THEN cast(0 AS bigint) ELSE cast(count(*) * 1000 AS bigint) END AS duration_ns, cast(count(*) AS double) * 80000 AS sm_cycles_elapsed, CASE WHEN cast(substring(p_brand, 7) AS int) % 8 = 0 THEN cast(0 AS double) ELSE cast(count(*) * 1000 AS double) END AS sm_cycles_max,
  CASE cast(substring(p_brand, 7) AS int) % 3 WHEN 0 THEN 'ncu' WHEN 1 THEN 'perf_llcproxy' ELSE '' END AS source, cast(0 AS double) AS l3_bytes, cast(cast(substring(p_brand, 7) AS int) * 4 AS double) AS occupancy_pct, cast(1 AS double) AS ipc
FROM (SELECT l_partkey, cast(l_extendedprice AS decimal(18,2)) AS l_extendedprice, cast(l_quantity AS decimal(18,2)) AS l_quantity, cast(l_tax AS decimal(18,2)) AS l_tax FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY p_brand
"""


def values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else repr(x)
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


TOKEN_ROWS = [(a, i, m, o) for a, ts in TOKENS.items() for i, (m, o) in enumerate(ts)]
# Devices to hold kernels against.
DEVICE_ROWS = [(0, "gpu A", "cuda", 19.5, 9.7, 78.0, 1555.0, 108, 1.41, 312.0, 6144.0, 0.0), (1, "cpu B", "cpu", 2.0, 1.0, 2.0, 100.0, 32, 3.0, 0.0, 0.0, 400.0)]
_DEVICE_COLS = "device_idx, name, backend, fp32_tflops, fp64_tflops, fp16_tflops, bandwidth_gbs, sm_count, core_clock_ghz, tensor_tflops, l2_bandwidth_gbs, l3_bandwidth_gbs"


def duck(*names: str) -> str:
    """CTEs for DuckDB, with those they need."""
    every = {
        "ev": _EVENTS, "spans": _SPANS, "counters": _COUNTERS, "nested": _NESTED, "folded": _STACKS, "kernels": _decimal_free(_KERNELS),
        "insn0": _INSNS, "tokens": f"SELECT * FROM (VALUES {values(TOKEN_ROWS)}) t(a, i, mnemonic, operands)",
        "insns": "SELECT kernel, arch, pos, mnemonic, operands, stall_cycles FROM insn0 JOIN tokens ON a = arch AND i = z % 12",
        "devices": f"SELECT {_DEVICE_COLS.replace(', ', ', ')} FROM (VALUES {values(DEVICE_ROWS)}) t({_DEVICE_COLS})",
        "wall": "SELECT greatest(max(end_ns) - min(start_ns), 1) AS wall_ns, min(start_ns) AS t0 FROM spans",
    }
    need = {"spans": ["ev"], "counters": ["ev"], "insns": ["insn0", "tokens"], "wall": ["ev", "spans"]}
    order: list[str] = []
    for n in names:
        for x in [*need.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({every[n].format(**DUCK) if n not in ('tokens', 'devices') else every[n]})" for n in order)


def _decimal_free(sql: str) -> str:
    """Sums of decimals as doubles: exact, whatever the order of addition."""
    out = sql
    for c in ("l_extendedprice", "l_quantity", "l_tax"):
        out = out.replace(f"sum({c})", f"cast(sum({c}) AS double)")
    return out


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, tables: list[str], **frames: DataFrame) -> DataFrame:
    args = {t: load(spark, sf_dir, t) for t in tables} | frames
    text = text.format(**SPARK)
    for t in args:
        import re

        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **args)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _EVENTS, ["events"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans with tags and links."""
    flat = _sql(spark, sf_dir, _SPANS, [], ev=events(spark, sf_dir))
    keys = ["type", "bytes", "stream", "side", "grid", "count"]
    tags = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"t_{k}"))]), lambda k, v: v.isNotNull())
    empty = F.array().cast("array<string>")
    return flat.withColumn("tags", tags).withColumn("stack_frames", empty).drop(*[f"t_{k}" for k in keys])


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _COUNTERS, [], ev=events(spark, sf_dir))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _NESTED, ["orders", "lineitem"])


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _STACKS, ["customer", "nation", "region"])


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.classify import classify

    base = _sql(spark, sf_dir, _INSNS, ["part"])
    tokens = spark.sql(f"SELECT * FROM VALUES {values(TOKEN_ROWS)} AS t(a, i, mnemonic, operands)")
    rows = base.join(F.broadcast(tokens), (F.col("a") == F.col("arch")) & (F.col("i") == F.col("z") % 12)).select("kernel", "arch", "pos", "mnemonic", "operands", "stall_cycles")
    return rows.withColumn("itype", classify(F.col("arch"), F.col("mnemonic"), F.col("operands")))


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _decimal_free(_KERNELS), ["lineitem", "part"])


def devices(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    kinds = ["int", "string", "string", *["double"] * 4, "int", *["double"] * 4]
    cols = [f"cast({c.strip()} as {t}) as {c.strip()}" for c, t in zip(_DEVICE_COLS.split(","), kinds)]
    return spark.sql(f"SELECT {', '.join(cols)} FROM VALUES {values(DEVICE_ROWS)} AS t({_DEVICE_COLS})")
