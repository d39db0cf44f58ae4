"""Two traces compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hotspots as H
from . import spans as S


def wall_change(a: DataFrame, b: DataFrame) -> DataFrame:
    one = S.wall(a).select(F.col("wall_ns").alias("before_ns")).crossJoin(S.wall(b).select(F.col("wall_ns").alias("after_ns")))
    return one.withColumns({"delta_ns": F.col("after_ns") - F.col("before_ns"), "pct": F.lit(100.0) * (F.col("after_ns") - F.col("before_ns")) / F.col("before_ns")})


def _outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x, y = a.select(*keys, F.col("total_ns").alias("before_ns")), b.select(*keys, F.col("total_ns").alias("after_ns"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return x.join(y, keys, "full").select(*keys, zero("before_ns"), zero("after_ns")).withColumn("delta_ns", F.col("after_ns") - F.col("before_ns"))


def category_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Time by category before and after, of categories of a thousandth of the wall time at least."""
    return _outer(H.breakdown(a), H.breakdown(b), ["category"]).where("before_ns > 0 or after_ns > 0")


def hotspot_changes(a: DataFrame, b: DataFrame, top: int = 15, look: int = 8, least_ms: float = 0.1) -> DataFrame:
    """The first hotspots of ``a`` that are among the hotspots of ``b`` and changed (by name; of equal names the last counts)."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy(F.desc("total_ns"), "category", "name"))  # over the few rows of a top list
    x = H.context_hotspots(a, top).select("category", "name", "total_ns").withColumn("k", order)
    y = H.context_hotspots(b, top).select("category", "name", "total_ns").withColumn("k", order)
    first = x.groupBy("name").agg(F.max_by("total_ns", "k").alias("before_ns"), F.min("k").alias("k")).orderBy("k").limit(look)
    last = y.groupBy("name").agg(F.max_by("total_ns", "k").alias("after_ns"))
    out = first.join(last, "name").withColumn("delta_ns", F.col("after_ns") - F.col("before_ns"))
    return out.where(F.abs("delta_ns") > least_ms * 1e6).select("name", "before_ns", "after_ns", "delta_ns")


def full(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every (category, name) of either trace."""
    return _outer(H.hotspots(a), H.hotspots(b), ["category", "name"])
