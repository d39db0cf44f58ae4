"""Names of kernels, frames, backends and datatypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of backends.
BACKEND_ALIASES = {"omp": "openmp", "cl": "opencl", "hip": "rocm", "perf": "cpu", "hwc": "likwid"}
# Bytes of MPI datatypes.
MPI_SIZES = {
    "MPI_BYTE": 1, "MPI_CHAR": 1, "MPI_UNSIGNED_CHAR": 1, "MPI_SHORT": 2, "MPI_UNSIGNED_SHORT": 2, "MPI_INT": 4, "MPI_UNSIGNED": 4, "MPI_FLOAT": 4,
    "MPI_LONG": 8, "MPI_UNSIGNED_LONG": 8, "MPI_DOUBLE": 8, "MPI_LONG_LONG": 8, "MPI_LONG_DOUBLE": 16,
}


def _lookup(x: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def backend(x: Column) -> Column:
    """A backend's full name."""
    return F.coalesce(_lookup(F.lower(x), BACKEND_ALIASES), F.lower(x))


def mpi_size(x: Column) -> Column:
    """Bytes of one element of an MPI datatype; 0 if it isn't known."""
    return F.coalesce(_lookup(x, MPI_SIZES), F.lit(0))


def jit_name(x: Column) -> Column:
    """``N.M.jit.so`` as ``[jit:…]`` with the last digits of both numbers; other names as they are."""
    n, m = (F.regexp_extract(x, r"^(\d+)\.(\d+)\.jit\.so$", k) for k in (1, 2))
    return F.when(n != "", F.concat(F.lit("[jit:"), F.right(n, F.lit(6)), F.lit("…"), F.right(m, F.lit(4)), F.lit("]"))).otherwise(x)


def short_kernel(x: Column) -> Column:
    """The function in a mangled kernel name ``…ZZ<length><name>…``, with its lambda's ordinal (``$_N``)."""
    length = F.regexp_extract(x, r"^.*?ZZ(\d*)", 1).try_cast("int")
    rest = F.regexp_extract(x, r"^.*?ZZ\d*(.*)$", 1)
    ordinal = F.regexp_extract(x, r"\$_(\d+)", 1)
    name = F.when(ordinal != "", F.concat(F.substring(rest, F.lit(1), length), F.lit("_"), ordinal)).otherwise(F.substring(rest, F.lit(1), length))
    return F.when((length > 0) & (F.length(rest) >= length), name).otherwise(x)


def suffix_name(x: Column) -> Column:
    """What follows the last ``::``."""
    return F.element_at(F.split(x, "::"), -1)


def frame_symbol(x: Column) -> Column:
    return F.split_part(x, F.lit("|"), F.lit(1))


def frame_library(x: Column) -> Column:
    return F.split_part(x, F.lit("|"), F.lit(2))


def frame_offset(x: Column) -> Column:
    return F.split_part(x, F.lit("|"), F.lit(3))


def frame_with_source(frame: Column, file: Column, line: Column) -> Column:
    """A frame ``sym|lib|off`` with ``(file:line)`` behind its symbol, if known."""
    where = F.concat(F.lit(" ("), F.element_at(F.split(file, "/"), -1), F.lit(":"), line.cast("string"), F.lit(")"))
    return F.when(file.isNotNull(), F.concat_ws("|", F.concat(frame_symbol(frame), where), frame_library(frame), frame_offset(frame))).otherwise(frame)


def hex_to_long(x: Column) -> Column:
    """A hexadecimal number (with or without 0x); null if it is none."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "^0x", ""), "^0+(?=.)", "")
    return F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("bigint"))


def colour_index(x: Column, n: int) -> Column:
    """A stable index below ``n`` from a name's digest."""
    return (F.conv(F.left(F.md5(x.cast("binary")), F.lit(8)), 16, 10).cast("bigint") % n).cast("int")


def dim3(x: Column) -> Column:
    """Volume of ``NxMxK``; parts that are no numbers count as one."""
    return F.aggregate(F.split(F.trim(F.coalesce(x, F.lit("1"))), "[x×]"), F.lit(1).cast("bigint"), lambda a, v: a * F.greatest(F.lit(1).cast("bigint"), F.coalesce(v.try_cast("bigint"), F.lit(1).cast("bigint"))))


def threads(tags: Column) -> Column:
    """Parallel work items of a span: grid times block, else a positive count, else one."""
    grid, block, count = (F.element_at(tags, k) for k in ("grid", "block", "count"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    use = lambda c: F.when(filled(c), c).otherwise(F.lit("1"))
    number = count.try_cast("bigint")
    return F.when(filled(grid) | filled(block), dim3(use(grid)) * dim3(use(block))).when(number > 0, number).otherwise(F.lit(1).cast("bigint"))
