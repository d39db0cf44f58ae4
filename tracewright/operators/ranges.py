"""Running sums and maxima within groups of any size.

Rows are dealt to ranges of (group, order), which are of about equal size
whatever the groups are like: a group of half the rows spreads over half of
the tasks.  Within a range a window runs on; what the ranges before it add is a
small table, a row for each range of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

_KINDS = {"sum": F.sum, "max": F.max}


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """``rows`` with, for each name in ``values``, the sum or maximum of a column over the group's rows up to this one (``before``: without it)."""
    order_ = [*by, *order]
    # written once: both branches below must see the same ranges
    parts = cut(rows.withColumns({f"{n}_v": c for n, (_, c) in values.items()}).repartitionByRange(*order_).withColumn("part_", F.spark_partition_id()))
    here = Window.partitionBy(*by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = parts.withColumns({n: _KINDS[k](f"{n}_v").over(here) for n, (k, _) in values.items()})
    total = parts.groupBy(*by, "part_").agg(*[_KINDS[k](f"{n}_v").alias(n) for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(*[F.col(c).alias(f"{c}_k") for c in (*by, "part_")], *[_KINDS[k](n).over(earlier).alias(f"{n}_c") for n, (k, _) in values.items()])
    on = F.lit(True)
    for c in (*by, "part_"):
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    out = local.join(carried, on)
    both = {n: F.coalesce(F.col(n) + F.col(f"{n}_c"), n, f"{n}_c") if k == "sum" else F.greatest(n, f"{n}_c") for n, (k, _) in values.items()}
    return out.select(*rows.columns, *[both[n].alias(n) for n in values])
