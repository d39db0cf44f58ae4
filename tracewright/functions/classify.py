"""Instruction classes by architecture, as ordered CASE expressions over regular expressions.

Rules are data: for each architecture a list of (class, condition), first match
wins.  Conditions are Java regular expressions over the trimmed mnemonic or the
operands, so that classification stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes.
CLASSES = ["vec_sp", "vec_dp", "vec_mem", "vector", "scalar", "memory", "control", "sync", "compute", "other"]

# Names by which architectures go.
ARCH = {
    "x86": ["x86", "x86-64", "x86_64", "amd64", "i386", "cpu"],
    "sass": ["sass", "cuda"],
    "amdgcn": ["amdgcn", "rocm", "hip", "gcn"],
    "ptx": ["ptx"],
    "aarch64": ["aarch64", "arm64", "armv8", "arm"],
    "rv64": ["rv64", "riscv64", "riscv", "rv32"],
}

# Patterns of mnemonics (m) and operands (o).
X86 = {
    "sync": "^(mfence|sfence|lfence|pause|lock)$",
    "control": "^(j[a-z]+|call[a-z]*|ret[a-z]*|loop[a-z]*|int|syscall|hlt|ud2)$",
    "compute": "^(fma|vfma|imul[a-z]*|idiv[a-z]*|mulx|adox|adcx)",
    "wide_operand": r"\b(ymm|zmm|[yk][0-7])\b",
    "vector": "^v[a-z]|^p[a-z]{2,}(?:b|w|d|q)",
    "xmm_operand": r"\bxmm[0-9]+\b",
    "memory": "^(mov[a-z]*|lea|push|pop|ld[a-z]*|st[a-z]*|prefetch[a-z]*|movnt[a-z]*)$",
    "vec_mem": "^v(?:mov|broadcast|gather|scatter|maskmov|pmaskmov|expand|compress)",
    "vec_sp": r"(?:ps|ss)\d*$",
    "vec_dp": r"(?:pd|sd)\d*$",
}
SASS = {
    "memory": r"^(LDG|STG|LDS|STS|LDL|STL|LD|ST|RED|ATOM|LDC|LDGSTS)\b",
    "sync": r"^(BAR|MEMBAR|CCTL|DEPBAR|SETLMEMBASE)\b",
    "control": r"^(BRA|CAL|RET|EXIT|BRX|JCAL|SYNC|SSY|BREAK|PRET|LONGJMP)\b",
    "compute": r"^(FFMA|DFMA|HFMA|FMUL|FADD|FDIV|DMUL|DADD|IMAD|IMUL|XMAD|HMMA|BMMA)\b",
}
PTX = {
    "vector": r"\.(v2|v4)\b",
    "sync": r"^(bar|membar|fence|atom)\b",
    "control": r"^(bra|call|ret|exit|brx|setp|selp)\b",
    "memory": r"^(ld|st|atom|red|prefetch|prefetchu|suld|sust)\b",
    "compute": r"^(fma|mad|mul|add|div)\b",
}
AARCH64 = {
    "sync": "^(dmb|dsb|isb|sevl|wfe|wfi|yield|sev|clrex)$",
    "control": r"^(b|bl|br|blr|ret|eret|b\.(eq|ne|cs|cc|hs|lo|mi|pl|vs|vc|hi|ls|ge|lt|gt|le|al)|cbz|cbnz|tbz|tbnz|svc|hvc|smc|brk|hlt|dcps[123])$",
    "compute": "^(fmadd|fmsub|fnmadd|fnmsub|madd|msub|smaddl|smsubl|umaddl|umsubl|mul|mneg|smull|smulh|umull|umulh)$",
    "simd_operand": r"\b[vqdhb]\d+\b",
    "simd": "^([su]?qadd|[su]?qsub|[su]?hadd|[su]?hsub|[su]?abd|[su]?max|[su]?min|[su]?addl[pv]?|[su]?addw|[su]?adalp|[su]?addv|[su]?mlal[12]?|[su]?mlsl[12]?|"
    "addp|addv|maxp|minp|[su]qrdmulh|[su]qrshl|[su]qrshrn[12]?|rev(16|32|64)|ext|dup|ins|umov|smov|movi|mvni|zip[12]|uzp[12]|trn[12]|tbl|tbx|"
    "aese|aesd|aesimc|aesmc|sha1[chm]|sha1h|sha256[hsu]|pmul|pmull[12]?|ld[1-4][rq]?|st[1-4]|ld[1-4]r)$",
    "memory": "^(ldr[bhwx]?|str[bhwx]?|ldp|stp|ldur[bhwx]?|stur[bhwx]?|ldnp|stnp|ldaxr[bhwx]?|stlxr[bhwx]?|ldxr[bhwx]?|stxr[bhwx]?|"
    "ldar[bhwx]?|stlr[bhwx]?|cas[a-z]*|swp[a-z]*|ld[auc][a-z]*|prfm|prfum)$",
    "vec_mem": "^(?:ld[1-4]r?q?|st[1-4]|ld1[wdhb]|ldff1[wdhb]|ldnt1[wdhb]|st1[wdhb]|stnt1[wdhb])$",
    "vec_dp": r"\bv\d+\.(?:2d|1d)\b|\bz\d+\.d\b",
    "vec_sp": r"\bv\d+\.(?:[24]s|[48]h)\b|\bz\d+\.(?:s|h)\b",
}
RV64 = {
    "sync": r"^fence(?:\.[it])?$",
    "control": r"^(?:beq|bne|bltu?|bgeu?|jal[r]?|ret|ecall|ebreak|[msu]ret|wfi|sfence\.\w+|hfence\.\w+|c\.j\w*)$",
    "vector_fma": "^vf(?:madd|msub|nmadd|nmsub|wmacc|nmacc|wnmacc|wnmsac)",
    "scalar_fma": r"^fn?m(?:add|sub)\.[sd]",
    "vec_mem": r"^v(?:le\d|lse\d|luxei\d|loxei\d|lm\b|l[1-8]r|se\d|sse\d|suxei\d|soxei\d|sm\b|s[1-8]r)",
    "memory": r"^(?:l[bhwdtq]u?|s[bhwdtq]|flw|fld|flh|fsw|fsd|fsh|lr\.[wd]|sc\.[wd]|amo\w+\.[wd]u?)$",
}


def _has(c: Column, pattern: str, fold: bool = True) -> Column:
    return c.rlike(("(?i)" if fold else "") + pattern)


def _first(rules: list[tuple[Column, Column | str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for when, what in reversed(rules):
        out = F.when(when, F.lit(what) if isinstance(what, str) else what).otherwise(out)
    return out


def x86(m: Column, o: Column) -> Column:
    p = X86
    kind = _first([(_has(m, p["vec_mem"]), "vec_mem"), (_has(m, p["vec_sp"]), "vec_sp"), (_has(m, p["vec_dp"]), "vec_dp")], "vector")
    simd = _has(o, p["wide_operand"]) | (_has(m, p["vector"]) & ~F.lower(m).isin("vzeroupper", "vzeroall")) | _has(o, p["xmm_operand"])
    rules = [(_has(m, p["sync"]), "sync"), (_has(m, p["control"]), "control"), (_has(m, p["compute"]), "compute"), (simd, kind)]
    return _first([*rules, (o.contains("[") & _has(m, p["memory"]), "memory")], "scalar")


def sass(m: Column, o: Column) -> Column:
    return _first([(_has(F.upper(m), SASS[k], False), k) for k in ("memory", "sync", "control", "compute")], "scalar")


def amdgcn(m: Column, o: Column) -> Column:
    m = F.lower(m)
    has = lambda *parts: _any([m.contains(p) for p in parts])
    starts = lambda *parts: _any([m.startswith(p) for p in parts])
    lanes = _first([(has("_f32", "_f16", "_bf16", "_f8"), "vec_sp"), (has("_f64"), "vec_dp")], "vector")
    scalar = _first([(has("branch") | (m == "s_endpgm"), "control"), (has("waitcnt", "barrier"), "sync")], "scalar")
    return _first([(starts("v_"), lanes), (starts("s_"), scalar), (starts("ds_", "flat_", "global_", "buffer_", "scratch_"), "memory")], "other")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def ptx(m: Column, o: Column) -> Column:
    return _first([(_has(m, PTX[k]), k) for k in ("vector", "sync", "control", "memory", "compute")], "scalar")


def aarch64(m: Column, o: Column) -> Column:
    p = AARCH64
    kind = _first([(_has(m, p["vec_mem"]), "vec_mem"), (_has(o, p["vec_dp"]), "vec_dp"), (_has(o, p["vec_sp"]), "vec_sp")], "vector")
    simd = _has(o, p["simd_operand"]) | _has(m, p["simd"])
    rules = [(_has(m, p[k]), k) for k in ("sync", "control", "compute")]
    return _first([*rules, (simd, kind), (_has(m, p["memory"]), "memory")], "scalar")


def rv64(m: Column, o: Column) -> Column:
    p = RV64
    fma = _has(m, p["vector_fma"]) | _has(m, p["scalar_fma"])
    low = F.lower(m)
    rules = [(_has(m, p["sync"]), "sync"), (_has(m, p["control"]), "control"), (fma, "compute"), (_has(m, p["vec_mem"]), "vec_mem")]
    return _first([*rules, (low.startswith("vf"), "vec_sp"), (low.startswith("v"), "vector"), (_has(m, p["memory"]), "memory")], "scalar")


_BY_ARCH = {"x86": x86, "sass": sass, "amdgcn": amdgcn, "ptx": ptx, "aarch64": aarch64, "rv64": rv64}


def classify(arch: Column, mnemonic: Column, operands: Column) -> Column:
    """The class of an instruction; ``other`` for unknown architectures."""
    a, m, o = F.lower(arch), F.trim(mnemonic), F.coalesce(operands, F.lit(""))
    return _first([(a.isin(ARCH[k]), f(m, o)) for k, f in _BY_ARCH.items()], "other")


def sass_stall(control: Column) -> Column:
    """The stall cycles in the control word of a SASS instruction (bits 11 to 8)."""
    from .names import hex_to_long

    digits = F.right(F.regexp_replace(F.lower(control), "^0x", ""), F.lit(8))
    return F.shiftright(hex_to_long(digits), 8).bitwiseAND(F.lit(15)).cast("int")
