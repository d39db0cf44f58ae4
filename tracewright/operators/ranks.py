"""Exact values by position, without gathering or globally sorting a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import running


def pick(df: DataFrame, by: str, value: str, places: dict[str, Callable]) -> DataFrame:
    """``by`` and, for each name in ``places``, the value at that position (from 0) of a group's ``n`` sorted values.

    Equal values are counted first; positions are running sums over these counts.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = running(counted, [by], [value], {"upto": ("sum", F.col("c"))})
    size = df.groupBy(by).agg(F.count(value).alias("n"))
    rows = upto.join(size, upto[by].eqNullSafe(size[by])).select(upto[by], value, "upto", "n")
    return rows.groupBy(by).agg(*[F.min(F.when(F.col("upto") > place(F.col("n")), F.col(value))).alias(name) for name, place in places.items()])
