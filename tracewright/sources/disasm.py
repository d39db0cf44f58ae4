"""Disassembly listings, symbol tables and source positions.

``texts`` has numbered lines (file, pos, value, as ``read`` gives them) or a row per
file: file, value (the whole text).  The kernel a line belongs to is carried down
over ranges of lines.  Lines are taken
apart by their separators and words, not by one pattern for each format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import classify, sass_stall
from ..functions.names import hex_to_long, short_kernel
from ..operators.ranges import running
from .lines import carry, explode_lines, group, numbered

def read(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark, path)


def _hex(c: Column) -> Column:
    """A hexadecimal number without a prefix; null if it is none."""
    c = F.trim(c)
    return F.when((c != "") & (F.translate(F.lower(c), "0123456789abcdef", "") == ""), hex_to_long(c))


def _word(c: Column) -> Column:
    return F.split(F.ltrim(F.translate(c, "\t", " ")), " +", 2)[0]


def _rest(c: Column) -> Column:
    """What follows the first word."""
    return F.coalesce(F.get(F.split(F.ltrim(F.translate(c, "\t", " ")), " +", 2), F.lit(1)), F.lit(""))


def _dotted(c: Column, first: str = "a-z", more: str = "") -> Column:
    """Whether a word can be a mnemonic: letters and digits (and ``more``), in parts with dots between."""
    return c.rlike(f"(?i)^[{first}]") & ~c.rlike(f"(?i)[^a-z0-9.{more}]") & ~c.endswith(".") & ~c.contains("..")


def _lines(rows: DataFrame, arch: str, addr: Column, mnemonic: Column, operands: Column, comment: Column | None = None, stall: Column | None = None) -> DataFrame:
    rows = rows.withColumns({"m_": mnemonic, "o_": F.trim(F.coalesce(operands, F.lit("")))})
    return rows.select(
        "file", "kernel", F.lit(arch).alias("arch"), F.col("pos"), addr.alias("addr"), F.col("m_").alias("mnemonic"), F.col("o_").alias("operands"), classify(F.lit(arch), F.col("m_"), F.col("o_")).alias("itype"),
        (comment if comment is not None else F.lit("")).alias("comment"), F.col("value").alias("raw"), (stall if stall is not None else F.lit(-1)).cast("int").alias("stall_cycles"),
    )


def sass(texts: DataFrame) -> DataFrame:
    """SASS instructions; the control line below an instruction holds its stall count.

    ``Function : name`` starts a kernel, ``/*address*/ [@predicate] mnemonic operands ;``
    is an instruction, and a line that is one comment holds a control word.
    """
    rows = explode_lines(texts, "file").withColumn("line", F.trim(F.translate("value", "\t", " ")))
    title = F.split("line", " *: *", 2)
    rows = rows.withColumn("start", F.when((title[0] == "Function") & (F.size(title) == 2), _word(title[1])))
    rows = carry(rows, "file", kernel=F.col("start")).where("start is null and kernel is not null")
    comment = F.when(F.col("line").contains("*/"), F.trim(F.substring_index(F.substring_index("line", "*/", 1), "/*", -1)))
    behind = F.ltrim(F.expr("substring(line, length(substring_index(line, '*/', 1)) + 3)"))
    behind = F.when(behind.startswith("@"), F.when(behind.startswith("@P") | behind.startswith("@!P"), _rest(behind)).otherwise(behind)).otherwise(behind)
    rows = rows.withColumns({"comment": comment, "code": F.when(behind.contains(";"), F.rtrim(F.substring_index(behind, ";", 1)))})
    rows = rows.withColumns({"addr": _hex(F.col("comment")), "m": _word(F.col("code"))})
    rows = rows.withColumn("insn", F.coalesce(F.col("addr").isNotNull() & (F.length("m") > 1) & _dotted(F.col("m"), more="_"), F.lit(False)))
    rows = rows.withColumn("control", F.when(~F.col("insn") & F.col("line").startswith("/*") & F.col("line").endswith("*/") & F.lower("comment").startswith("0x"), F.col("comment")))
    # the last control line before the next instruction of the kernel counts
    rows = running(rows, ["file", "kernel"], ["pos"], {"n": ("sum", F.col("insn").cast("int"))})
    word = rows.where("control is not null").groupBy("file", "kernel", "n").agg(F.max_by("control", "pos").alias("word"))
    rows = rows.where("insn").join(word, ["file", "kernel", "n"], "left")
    return _lines(rows, "sass", F.col("addr"), F.col("m"), _rest(F.col("code")), None, F.coalesce(sass_stall(F.col("word")), F.lit(-1)))


def ptx(texts: DataFrame) -> DataFrame:
    """PTX instructions, indented and ended by semicolons; mangled kernel names are shortened."""
    rows = explode_lines(texts, "file")
    flat = F.translate("value", "\t", " ")
    title = F.coalesce(*[F.when(flat.contains(f"{k} "), F.trim(F.substring_index(F.split_part(flat, F.lit(f"{k} "), F.lit(2)), "(", 1))) for k in (".entry", ".func")], F.lit(""))
    rows = rows.withColumn("start", F.when((title != "") & ~title.contains(" "), title))
    rows = carry(rows, "file", kernel=F.col("start")).withColumn("kernel", short_kernel(F.col("kernel"))).where("start is null and kernel is not null")
    code = F.when(F.substring("value", 1, 1).isin(" ", "\t") & F.col("value").contains(";"), F.trim(F.substring_index(F.translate("value", "\t", " "), ";", 1)))
    rows = rows.withColumn("code", code).withColumn("m", _word(F.col("code"))).where(_dotted(F.col("m")))
    return _lines(rows, "ptx", F.lit(0).cast("bigint"), F.col("m"), _rest(F.col("code")))


def _addressed(rows: DataFrame) -> DataFrame:
    """``address: code`` lines with addr and code."""
    rows = rows.withColumn("addr", F.when(F.col("value").contains(":"), _hex(F.translate(F.substring_index("value", ":", 1), "\t", " "))))
    code = F.trim(F.translate(F.expr("substring(value, length(substring_index(value, ':', 1)) + 2)"), "\t", " "))
    return rows.withColumn("code", code).where("addr is not null")


def amdgcn(texts: DataFrame) -> DataFrame:
    """AMDGCN instructions: ``<name>:`` starts a kernel; an encoding of eight digits before the mnemonic is left out."""
    rows = explode_lines(texts, "file").withColumn("line", F.rtrim("value"))
    rows = rows.withColumn("start", F.when(F.col("line").startswith("<") & F.col("line").contains(">:"), F.expr("substring(substring_index(line, '>:', 1), 2)")))
    rows = _addressed(carry(rows, "file", kernel=F.col("start")).where("start is null and kernel is not null"))
    coded = (F.length(_word(F.col("code"))) == 8) & _hex(_word(F.col("code"))).isNotNull() & (_rest(F.col("code")) != "")
    rows = rows.withColumn("code", F.when(coded, _rest(F.col("code"))).otherwise(F.col("code"))).withColumn("m", _word(F.col("code")))
    rows = rows.where((F.length("m") > 1) & _dotted(F.col("m"), "a-z_", "_") & ~F.col("m").contains("."))
    return _lines(rows, "amdgcn", F.col("addr"), F.col("m"), _rest(F.col("code")))


def objdump(texts: DataFrame, symbol: str | None = None, arch: str = "x86-64") -> DataFrame:
    """Instructions of an objdump listing, of all symbols or of those whose name holds ``symbol``."""
    rows = explode_lines(texts, "file").withColumn("value", F.rtrim("value"))
    titled = F.col("value").endswith(">:") & _hex(F.substring_index("value", " <", 1)).isNotNull()
    rows = rows.withColumn("start", F.when(titled, F.expr("substring(value, length(substring_index(value, ' <', 1)) + 3, length(value) - length(substring_index(value, ' <', 1)) - 4)")))
    rows = carry(rows, "file", kernel=F.col("start")).where("start is null")
    rows = rows.where(F.col("kernel").contains(symbol)) if symbol is not None else rows
    rows = _addressed(rows).where(~F.col("value").endswith(":")).withColumn("m", _word(F.col("code"))).where(_dotted(F.col("m")))
    operands = F.rtrim(F.substring_index(_rest(F.col("code")), "#", 1))
    note = F.when(F.col("code").contains("#"), F.trim(F.expr("substring(code, length(substring_index(code, '#', 1)) + 2)"))).otherwise(F.lit(""))
    return _lines(rows.withColumn("kernel", F.coalesce("kernel", F.lit(""))), arch, F.col("addr"), F.col("m"), operands, note)


def symbols(lines: DataFrame, code_only: bool = True) -> DataFrame:
    """addr, size, name from lines of ``nm -S`` (addr size kind name) or ``nm`` (addr kind name)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("p", p)
    sized = rows.where(F.size("p") == 4).select(hex_to_long(F.col("p")[0]).alias("addr"), hex_to_long(F.col("p")[1]).alias("size"), F.col("p")[2].alias("kind"), F.col("p")[3].alias("name"))
    bare = rows.where(F.size("p") == 3).select(hex_to_long(F.col("p")[0]).alias("addr"), F.lit(None).cast("bigint").alias("size"), F.col("p")[1].alias("kind"), F.col("p")[2].alias("name"))
    out = sized.unionByName(bare).where("addr is not null")
    return (out.where(F.col("kind").isin("T", "t", "W", "w")) if code_only else out).drop("kind")


def perf_annotate(lines: DataFrame) -> DataFrame:
    """addr, pct of annotated listings (``per cent : address: code``), samples only."""
    p = F.split("value", ":", 3)
    rows = lines.select(_hex(F.get(p, F.lit(1))).alias("addr"), F.trim(p[0]).try_cast("double").alias("pct")).where("addr is not null")
    return rows.where("pct > 0").groupBy("addr").agg(F.max("pct").alias("pct"))


def resolved(lines: DataFrame, lib: str, addresses: DataFrame) -> DataFrame:
    """lib, offset, file, line of a symbolizer's output: a name and a ``file:line`` for each address (pos, addr) in turn."""
    rows = explode_lines(lines, "file").where("pos % 2 = 1").select(((F.col("pos") - 1) / 2).cast("int").alias("pos"), F.trim("value").alias("v")).where(~F.col("v").contains("??") & F.col("v").rlike(r":\d+$"))
    rows = rows.select("pos", F.regexp_extract("v", r"^(.*):(\d+)$", 1).alias("file"), F.regexp_extract("v", r"^(.*):(\d+)$", 2).cast("int").alias("line"))
    return addresses.join(rows, "pos").select(F.lit(lib).alias("lib"), F.col("addr").alias("offset"), "file", "line")


def dwarf_lines(texts: DataFrame) -> DataFrame:
    """addr, file, line of decoded line tables; the compilation unit's file where a row names none."""
    rows = explode_lines(texts, "file").select(F.col("file").alias("of"), "pos", F.trim("value").alias("value"))
    unit = F.trim(group(r"^CU:\s*(.+):", 1))
    rows = carry(rows, "of", unit=unit)
    pattern = r"(?i)^(.+?)\s+(\d+)\s+(0x[0-9a-f]+)"
    at = lambda k: F.regexp_extract("value", pattern, k)
    rows = rows.where(F.col("value").rlike(pattern) & ~F.col("value").startswith("CU:")).select("pos", F.when(F.trim(at(1)) != "", F.trim(at(1))).otherwise(F.col("unit")).alias("file"), at(2).cast("int").alias("line"), hex_to_long(at(3)).alias("addr"))
    return rows.where("file <> 'File name'").groupBy("addr").agg(F.max_by(F.struct("file", "line"), "pos").alias("s")).select("addr", "s.file", "s.line")


def listing_lines(texts: DataFrame) -> DataFrame:
    """addr, file, line from ``; file:line`` comments above instructions."""
    rows = explode_lines(texts, "file").withColumnRenamed("file", "of").withColumn("where_", group(r"^; (.+:\d+)$", 1))
    rows = carry(rows, "of", at=F.col("where_"))
    rows = rows.where(F.col("where_").isNull() & F.col("at").isNotNull() & F.col("value").rlike(r"(?i)^\s*[0-9a-f]+:"))
    return rows.select(hex_to_long(F.regexp_extract("value", r"(?i)^\s*([0-9a-f]+):", 1)).alias("addr"), F.regexp_extract("at", r"^(.+):(\d+)$", 1).alias("file"), F.regexp_extract("at", r"^(.+):(\d+)$", 2).cast("int").alias("line"))


def ptx_lines(texts: DataFrame) -> DataFrame:
    """addr, file, line from ``.file`` and ``.loc`` directives."""
    rows = explode_lines(texts, "file").withColumnRenamed("file", "of")
    f = r'^\s*\.file\s+(\d+)\s+"([^"]+)"'
    loc = r"^\s*\.loc\s+(\d+)\s+(\d+)"
    files = rows.where(F.col("value").rlike(f)).select("of", F.regexp_extract("value", f, 1).alias("n"), F.regexp_extract("value", f, 2).alias("file")).dropDuplicates(["of", "n"])
    now = F.when(F.col("value").rlike(loc), F.struct(F.regexp_extract("value", loc, 1).alias("n"), F.regexp_extract("value", loc, 2).cast("int").alias("line")))
    rows = carry(rows, "of", l=now)
    a = r"(?i)^\s*/\*\s*([0-9a-f]+)\s*\*/"
    rows = rows.where(F.col("value").rlike(a) & F.col("l").isNotNull()).select("of", hex_to_long(F.regexp_extract("value", a, 1)).alias("addr"), F.col("l.n").alias("n"), F.col("l.line").alias("line"))
    return rows.join(files, ["of", "n"]).select("addr", "file", "line")
