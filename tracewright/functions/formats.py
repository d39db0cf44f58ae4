"""Numbers and names as text.  All are column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def printf(x: Column, digits: int, unit: str) -> Column:
    """A double with so many digits after the point, as C's printf has it: its exact binary value is rounded, ties go to the even digit.

    (Java rounds the shortest decimal text half up.)  With digits after the point ``x`` is 1 or more; whole
    numbers of 2^106 and more have Java's zeros after their first 17 digits.
    """
    size = F.abs(x)
    big = size >= F.lit(2.0**53)  # such a number is whole
    high = F.floor(F.least(size, F.lit(2.0**105)) / F.lit(2.0**53))
    low = (size - high.cast("double") * F.lit(2.0**53)).cast("long")
    whole = (high.cast("decimal(19,0)") * F.lit(2**53).cast("decimal(16,0)") + F.when(big & (size < F.lit(2.0**106)), low).otherwise(F.lit(0)).cast("decimal(19,0)")).cast("string")
    tail = F.lit("." + "0" * digits if digits else "")
    whole = F.when(size < F.lit(2.0**106), F.concat(F.when(x < 0, "-").otherwise(""), whole, tail)).otherwise(F.format_string(f"%.{digits}f", x))
    if digits:
        small = F.when(big, F.lit(1.0)).otherwise(size)
        i = F.floor(small)
        p = ((small - i.cast("double")) * F.lit(2.0**52)).cast("long") * F.lit(10**digits)  # exact: below 2^62
        q, r, half = F.shiftright(p, 52), p.bitwiseAND(F.lit(2**52 - 1)), F.lit(2**51)
        over = q + F.when((r > half) | ((r == half) & (q % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
        carry = F.when(over >= 10**digits, F.lit(1)).otherwise(F.lit(0))
        text = F.concat((i + carry).cast("string"), F.lit("."), F.lpad((over - carry * F.lit(10**digits)).cast("string"), digits, "0"))
    else:
        text = F.format_string("%.0f", F.rint(x))
    out = F.when(F.isnan(x), "nan").when(size == F.lit(float("inf")), F.when(x < 0, "-inf").otherwise("inf")).when(big, whole).otherwise(text)
    return F.concat(out, F.lit(unit))


def _once(x: Column, text: Callable[[Column], Column]) -> Column:
    """``text`` of ``x``, which is computed once: written out each time, it would make more code than the JVM compiles."""
    return F.transform(F.array(x), text)[0]


def _scaled(x: Column, steps: list[tuple[float, int, str]], last: str) -> Column:
    """The first step that ``x`` reaches decides its unit; what is smaller is whole, with the ``last`` unit."""

    def text(v: Column) -> Column:
        out = printf(v, 0, last)
        for least, digits, unit in reversed(steps):
            out = F.when(v >= least, printf(v / F.lit(least), digits, unit)).otherwise(out)
        return F.when(v.isNotNull(), out)

    return _once(x, text)


def fmt_ns(x: Column) -> Column:
    """Nanoseconds as s, ms, µs or ns."""
    return _scaled(x.cast("double"), [(1e9, 3, "s"), (1e6, 2, "ms"), (1e3, 1, "µs")], "ns")


def fmt_bytes(x: Column) -> Column:
    """Bytes as GB, MB, KB or B (binary steps)."""
    return _scaled(x.cast("double"), [(1024.0**3, 2, " GB"), (1024.0**2, 1, " MB"), (1024.0, 0, " KB")], " B")


def _two_digits(x: Column) -> Column:
    """A number below 0.001 as C's %.1e: Java rounds its shortest decimal text, which may end in a 5 that the binary value doesn't reach.

    Whether it does is told by the exact product with a power of ten, as a sum of two doubles (Dekker); below 1e-20 it is Java's digits.
    """
    size = F.abs(x)
    text = size.cast("string")
    tie = (size < 1e-3) & (size > 1e-20) & text.rlike(r"^[1-9][.][0-9]5E-")
    n = F.regexp_replace(F.substring(text, 1, 4), "[.]", "").cast("double")
    scale = F.pow(F.lit(10.0), F.when(tie, 2.0 + F.substring(text, 7, 9).cast("double")).otherwise(0.0))  # 10^22 at most: exact
    split = lambda v: v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)
    xh, sh, product = split(size), split(scale), size * scale
    xl, sl = size - xh, scale - sh
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    short = (product - n) + error < 0
    number = F.format_string("%.1e", F.when(tie & short, x * F.lit(1 - 1e-12)).otherwise(x))
    return F.when(F.isnan(x), "nan").when(size == F.lit(float("inf")), F.when(x < 0, "-inf").otherwise("inf")).otherwise(number)


def fmt_tflops(x: Column) -> Column:
    """TFLOP/s as PF, TF or GF; below a GFLOP/s with two significant digits."""
    return _once(
        x.cast("double"),
        lambda v: F.when(v >= 1000, printf(v / 1000, 1, " PF"))
        .when(v >= 1, printf(v, 1, " TF"))
        .when(v >= 0.001, printf(v * 1000, 0, " GF"))
        .otherwise(F.concat(_two_digits(v), F.lit(" TF"))),
    )


def ms(x: Column) -> Column:
    """Nanoseconds in milliseconds; rounding is left to presentation."""
    return x.cast("double") / F.lit(1e6)


def snake(x: Column) -> Column:
    """A metric name in lower case with single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def perf_event(x: Column) -> Column:
    """A counter event's name without its unit prefix and privilege suffix."""
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "/+$", ""), "^[\\w-]+/", "")))
    return F.regexp_replace(bare, ":[ukphgUKPHG]+$", "")


def symbol(x: Column) -> Column:
    """A symbol without its ``+offset``; empty for unknown ones."""
    return F.when(x.isNull() | (x == "") | (x == "[unknown]"), F.lit("")).otherwise(F.split_part(x, F.lit("+"), F.lit(1)))


def bar(share: Column, width: int = 20) -> Column:
    """A bar of full and empty blocks for a share between 0 and 1."""
    n = F.least(F.greatest(F.floor(share * width).cast("int"), F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def fine_bar(share: Column, width: int = 20) -> Column:
    """A bar that resolves eighths of a cell."""
    eighths = F.least(F.greatest(F.floor(share * width * 8).cast("int"), F.lit(0)), F.lit(8 * width))
    full = F.floor(eighths / 8).cast("int")
    part = F.substring(F.lit("▏▎▍▌▋▊▉"), eighths % 8, F.lit(1))
    return F.rpad(F.concat(F.repeat(F.lit("█"), full), F.when(eighths % 8 > 0, part).otherwise(F.lit(""))), width, " ")


def spark_level(value: Column, low: Column, high: Column) -> Column:
    """One of eight levels (0 to 7) between the least and the largest value."""
    return F.when(high <= low, F.lit(0)).otherwise(F.floor((value - low) / (high - low) * 7).cast("int"))


def sparkline(values: Column, width: int = 12) -> Column:
    """The last values of an array as block characters."""
    low, high = F.array_min(values), F.array_max(values)
    last = F.slice(values, F.greatest(F.size(values) - width + 1, F.lit(1)), width)
    text = F.array_join(F.transform(last, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), spark_level(v, low, high) + 1, F.lit(1))), "")
    return F.rpad(F.when(F.size(values) > 0, text).otherwise(F.lit("")), width, " ")


def grade(x: Column) -> Column:
    """A letter for an efficiency in per cent."""
    return F.when(x >= 85, "A+").when(x >= 70, "A").when(x >= 55, "B").when(x >= 35, "C").when(x >= 15, "D").otherwise("F")
