"""Text with and without line order.

Formats whose lines stand for themselves are read line by line, split as Spark
likes.  Where lines depend on those before them, lines are numbered by their
place in the file, and what they depend on is carried along by running maxima
over ranges of lines (``carry``): no task holds a file, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import running


def free_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one row per line."""
    return spark.read.text(path)


def _placed(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """file, place, value: the lines of files with their place (from 0) in the file, or with ``by`` empty in all of them.

    A line's place in its split is known where it is read; how many lines come before the split is summed up
    over splits.  Lines are read twice, and neither copied nor sorted.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block_"), F.monotonically_increasing_id().alias("line_"), "value")
    splits = rows.groupBy("file", "block_").agg(F.min("line_").alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*by).orderBy("file", "block_").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("base_"))
    return rows.join(splits, ["file", "block_"]).select("file", (F.col("line_") + F.col("base_")).alias("place"), "value")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value: the lines of each file, numbered in order; large files are split."""
    return _placed(spark, path, ["file"]).select("file", F.col("place").cast("int").alias("pos"), F.regexp_replace("value", "\r$", "").alias("value"))


def sequenced(spark: SparkSession, path: str) -> DataFrame:
    """value, seq: the lines of all files in order of file and place."""
    return _placed(spark, path, []).select("value", F.col("place").alias("seq"))


def explode_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """Lines with their positions, keeping ``keys``: of whole texts (value), or numbered ones as they are."""
    if "pos" in texts.columns:
        return texts.select(*keys, "pos", "value")
    rows = texts.select(*keys, F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return rows.select(*keys, "pos", F.col("line").alias("value"))


def carry(rows: DataFrame, by: str, **values: Column) -> DataFrame:
    """``rows`` with the last value of each column that isn't null, up to this line of its file."""
    last = {n: ("max", F.when(c.isNotNull(), F.struct(F.col("pos").alias("pos"), c.alias("value")))) for n, c in values.items()}
    return running(rows, [by], ["pos"], last).withColumns({n: F.col(n)["value"] for n in values})


def group(pattern: str, n: int, c: str = "value") -> Column:
    """A regular expression's group; null where it doesn't match."""
    return F.when(F.col(c).rlike(pattern), F.regexp_extract(c, pattern, n))


def number(c: Column) -> Column:
    """A number that may hold grouping commas or blanks; null if it is none."""
    return F.regexp_replace(c, "[, \u00a0\u202f]", "").try_cast("double")
