"""Calling context trees: self and inclusive measures of every call path.

Equal paths are aggregated before prefixes are taken, so the explosion by depth
runs over distinct paths, not over spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import frame_symbol


def prefixes(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """A row for each non-empty prefix of ``path``: prefix, full (length of the whole), kept columns."""
    rows = df.where(F.size(path) > 0).select(*keep, F.col(path).alias("p_"), F.explode(F.sequence(F.lit(1), F.size(path))).alias("i_"))
    return rows.select(*keep, F.slice("p_", 1, F.col("i_")).alias("prefix"), F.size("p_").alias("full"))


def paths(spans: DataFrame, compat: bool = False) -> DataFrame:
    """seq, path (outermost first), category, duration_ns of spans with stacks and of distinct samples.

    With ``compat`` a sample's first recorded name is appended to its path too.
    """
    stacked = spans.where("size(stack_frames) > 0").select("seq", F.concat(F.reverse("stack_frames"), F.array("name")).alias("path"), "category", "duration_ns")
    sampled = spans.where("category = 'cpu' and duration_ns = 0 and (stack_frames is null or size(stack_frames) = 0)").where("coalesce(tags['stack'], '') <> ''")
    one = sampled.groupBy("pid", "tid", "start_ns").agg(F.min_by(F.struct("seq", "name", F.col("tags")["stack"].alias("stack")), "seq").alias("s")).select("s.*")
    frames = F.filter(F.split("stack", ";"), lambda x: (x != "") & (x != "[cpu]"))
    path = F.concat(frames, F.array("name")) if compat else frames
    samples = one.select("seq", path.alias("path"), F.lit("cpu").alias("category"), F.lit(0).cast("bigint").alias("duration_ns")).where(F.size("path") > 0)
    return stacked.unionByName(samples)


def build(rows: DataFrame) -> DataFrame:
    """Nodes of the tree: own and inclusive time and counts, extremes and categories of what ended there."""
    own = rows.groupBy("path").agg(
        F.count("*").alias("self_count"), F.sum("duration_ns").alias("self_ns"), F.min("duration_ns").alias("self_min_ns"), F.max("duration_ns").alias("self_max_ns"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
    incl = prefixes(own.select("path", "self_ns", "self_count"), "path", ["self_ns", "self_count"]).groupBy(F.col("prefix").alias("path"))
    incl = incl.agg(F.sum("self_ns").alias("incl_ns"), F.sum("self_count").alias("incl_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = incl.join(own, "path", "left")
    return out.select(
        "path", F.element_at("path", -1).alias("frame"), F.size("path").alias("depth"), zero("self_count"), zero("self_ns"), "self_min_ns", "self_max_ns",
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "incl_ns", "incl_count",
    )


def top_self(nodes: DataFrame, n: int = 15, category: str | None = None) -> DataFrame:
    rows = nodes.where("self_count > 0")
    rows = rows.where(F.array_contains("categories", category)) if category else rows
    return rows.withColumn("self_avg_ns", F.col("self_ns") / F.col("self_count")).orderBy(F.desc("self_ns"), "path").limit(n)


def top_inclusive(nodes: DataFrame, n: int = 15, category: str | None = None) -> DataFrame:
    rows = nodes.where(F.array_contains("categories", category)) if category else nodes
    return rows.orderBy(F.desc("incl_ns"), "path").limit(n)


def total_exclusive(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.coalesce(F.sum("self_ns"), F.lit(0)).alias("total_ns"))


def display_path(path: str = "path") -> Column:
    """Display names of a path; long ones keep their last two frames."""
    short = lambda n: lambda f: F.left(F.split_part(frame_symbol(f), F.lit("("), F.lit(1)), F.lit(n))
    tail = F.concat(F.lit("…/"), F.array_join(F.transform(F.slice(path, -2, 2), short(20)), "/"))
    return F.left(F.when(F.size(path) > 3, tail).otherwise(F.array_join(F.transform(path, short(22)), "/")), F.lit(42))


def root(nodes: DataFrame) -> DataFrame:
    """Inclusive measures of the whole tree."""
    return nodes.where("depth = 1").agg(F.sum("incl_ns").alias("incl_ns"), F.sum("incl_count").alias("incl_count"))


def ranked(nodes: DataFrame) -> DataFrame:
    """Nodes with their rank among siblings by inclusive time."""
    parent = F.slice("path", 1, F.size("path") - 1)
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("incl_ns"), "frame")))
