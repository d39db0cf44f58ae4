"""Instruction mix and optimisation hints.

``lines`` has a row per instruction: kernel, arch, mnemonic, operands, itype,
stall_cycles.  All measures of all kernels come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import ARCH


def mix(lines: DataFrame) -> DataFrame:
    """Number and share of each instruction class of each kernel, ``other`` left out."""
    by = lines.where("itype <> 'other'").groupBy("kernel", "itype").agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("kernel")))


def totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("kernel").agg(F.count("*").alias("n"))


# Scalar and packed floating-point mnemonics without fusion.
UNFUSED = ["mulss", "addss", "subss", "mulsd", "addsd", "subsd", "mulps", "addps", "subps", "mulpd", "addpd", "subpd"]


def _measures() -> dict[str, Column]:
    """What the rules look at: counts of instructions by condition."""
    m, o, t = F.lower("mnemonic"), F.coalesce("operands", F.lit("")), F.col("itype")
    low, both = F.lower(o), F.lower(F.concat(o, F.col("mnemonic")))
    sass = lambda p: F.upper("mnemonic").rlike(f"^({p})\\b")
    any_ = lambda c, *parts: F.greatest(*[c.contains(p).cast("int") for p in parts], F.lit(0)) == 1
    return {
        "vec": t.isin("vec_sp", "vec_dp", "vec_mem", "vector"), "compute": t == "compute", "memory": t == "memory", "control": t == "control",
        "spill": any_(o, "[rsp", "[rbp"), "unfused": m.isin(UNFUSED), "wide": any_(low, "ymm", "zmm"), "xmm": low.contains("xmm"), "calls": m.startswith("call"),
        "s_global": sass("LDG|STG"), "s_shared": sass("LDS|STS|LDGSTS"), "s_compute": sass("FFMA|DFMA|HMMA|BMMA|IMAD|HFMA|FMUL|FADD|DMUL|DADD"), "s_bar": sass("BAR"), "s_atom": sass("ATOM|RED"),
        "s_async": sass("LDGSTS"), "s_hfma": sass("HFMA"), "s_hmma": sass("HMMA"), "s_stall": F.coalesce(F.col("stall_cycles") >= 10, F.lit(False)),
        "p_global": (m.startswith("ld") | m.startswith("st")) & both.contains(".global"), "p_shared": both.contains(".shared"), "p_atom": m.isin("atom", "red"), "p_bar": m == "bar",
        "p_vec": any_(F.col("mnemonic"), ".v2", ".v4") | any_(o, ".v2", ".v4"),
        "a_valu": m.startswith("v_"), "a_lds": m.startswith("ds_"), "a_global": m.startswith("buffer_") | m.startswith("global_") | m.startswith("flat_"), "a_wait": m.contains("waitcnt"),
    }


def measures(lines: DataFrame) -> DataFrame:
    """Instruction counts of each kernel by condition."""
    counts = [F.count(F.when(c, 1)).alias(k) for k, c in _measures().items()]
    return lines.groupBy("kernel", "arch").agg(F.count("*").alias("n"), *counts)


def _rules() -> list[tuple[str, int, str, str, str, Column]]:
    """Architecture, least size, rule, severity, category, condition.  Thresholds are fixed values."""
    n, c = F.col("n"), F.col
    pct = lambda k: F.lit(100.0) * c(k) / n
    many_calls = c("calls") > 3
    return [
        ("cpu", 8, "low_vectorisation", "warn", "vectorize", (pct("vec") < 10) & (n >= 20)),
        ("cpu", 8, "memory_heavy", "warn", "memory", pct("memory") > 35),
        ("cpu", 8, "register_spills", "warn", "register", pct("spill") > 8),
        ("cpu", 8, "unfused_fp", "info", "compute", (c("unfused") > 0) & (pct("compute") < 3) & (n >= 15)),
        ("cpu", 8, "narrow_simd", "info", "vectorize", (c("xmm") > 0) & (c("wide") == 0) & (n >= 20)),
        ("cpu", 8, "frequent_calls", "info", "branch", (pct("control") > 15) & (n >= 20) & many_calls),
        ("cpu", 8, "branch_density", "info", "branch", (pct("control") > 15) & (n >= 20) & ~many_calls),
        ("sass", 5, "global_without_shared", "crit", "memory", (pct("s_global") > 20) & (c("s_shared") < 3) & (n >= 15)),
        ("sass", 5, "low_compute", "warn", "compute", (pct("s_compute") < 15) & (n >= 20)),
        ("sass", 5, "high_stalls", "warn", "memory", pct("s_stall") > 20),
        ("sass", 5, "barriers", "warn", "sync", pct("s_bar") > 4),
        ("sass", 5, "atomics", "info", "compute", pct("s_atom") > 5),
        ("sass", 5, "half_without_tensor", "info", "compute", (c("s_hfma") > 0) & (c("s_hmma") == 0)),
        ("sass", 5, "no_async_copy", "info", "memory", (c("s_global") > 5) & (c("s_async") == 0) & (n >= 30)),
        ("ptx", 5, "global_without_shared", "warn", "memory", (pct("p_global") > 20) & (c("p_shared") < 3) & (n >= 15)),
        ("ptx", 5, "atomics", "info", "compute", pct("p_atom") > 5),
        ("ptx", 5, "barriers", "info", "sync", pct("p_bar") > 3),
        ("ptx", 5, "no_vector_loads", "info", "memory", (pct("p_vec") < 5) & (c("p_global") > 5) & (n >= 20)),
        ("amdgcn", 5, "low_valu", "warn", "compute", (pct("a_valu") < 30) & (n >= 20)),
        ("amdgcn", 5, "global_without_lds", "crit", "memory", (pct("a_global") > 20) & (c("a_lds") < 5) & (n >= 15)),
        ("amdgcn", 5, "waits", "warn", "memory", pct("a_wait") > 5),
    ]


#: What each rule tells the reader.
TEXT = {
    "low_vectorisation": "few SIMD instructions: let the compiler vectorise for the machine at hand",
    "memory_heavy": "many loads and stores: block loops or change the data layout",
    "register_spills": "many stack accesses: split large loop bodies",
    "unfused_fp": "multiplications and additions aren't fused",
    "narrow_simd": "128-bit vectors only: wider ones are available with the right target flags",
    "frequent_calls": "many calls in hot code: inline them",
    "branch_density": "many branches: unroll or use predication",
    "global_without_shared": "much global memory traffic without shared memory: stage tiles",
    "low_compute": "few arithmetic instructions: the kernel waits for memory or control flow",
    "high_stalls": "many instructions are scheduled with long stalls: raise parallelism",
    "barriers": "many barriers: merge phases or use warp-level primitives",
    "atomics": "many atomics: reduce within a block first",
    "half_without_tensor": "half precision without matrix instructions",
    "no_async_copy": "global loads aren't asynchronous",
    "no_vector_loads": "no vector loads: use wider types",
    "low_valu": "few vector instructions against scalar ones",
    "global_without_lds": "much global memory traffic without local data share",
    "waits": "many waits for memory",
}


def advise(lines: DataFrame) -> DataFrame:
    """kernel, rule, severity, category and text of every hint that applies; unknown architectures have none."""
    arch = F.lower("arch")
    group = F.when(arch.isin(*[a for a in ARCH["x86"] if a != "i386"], "aarch64", "arm64"), "cpu")
    for k in ("sass", "ptx", "amdgcn"):
        group = group.when(arch.isin(ARCH[k]), k)
    rows = measures(lines).withColumn("group_", group)
    hits = [
        F.when((F.col("group_") == g) & (F.col("n") >= least) & when, F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"), F.lit(TEXT[rule]).alias("message")))
        for g, least, rule, sev, cat, when in _rules()
    ]
    return rows.select("kernel", F.explode(F.array_compact(F.array(*hits))).alias("a")).select("kernel", "a.*")


def processor_hints(counters: DataFrame) -> DataFrame:
    """Words for processor counters (name, value)."""
    v, k = F.col("value"), F.col("name")
    ipc = F.when(v >= 3, "excellent").when(v >= 2, "good").when(v >= 1, "moderate").otherwise("low")
    cache = F.when(v < 5, "good").when(v < 20, "moderate").otherwise("high")
    branch = F.when(v < 1, "good").when(v < 5, "moderate").otherwise("high")
    ridge = F.when(v < 5, "bandwidth-rich").when(v < 30, "balanced").otherwise("compute-rich")
    return counters.where(k.isin("ipc", "cache_miss_pct", "branch_miss_pct", "ridge")).select("name", "value", F.when(k == "ipc", ipc).when(k == "cache_miss_pct", cache).when(k == "branch_miss_pct", branch).otherwise(ridge).alias("verdict"))
