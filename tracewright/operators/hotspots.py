"""Where the time goes: aggregation by name and category, details, efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GPU_TIMELINE
from . import spans as S
from .ranks import pick


def hotspots(spans: DataFrame) -> DataFrame:
    """Count, total, min, max, mean and share of all span time by category and name."""
    by = spans.groupBy("category", "name").agg(
        F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns")
    )
    out = S.with_sum(by, "total_ns")
    return out.withColumns({"avg_ns": F.col("total_ns") / F.col("count"), "pct": F.when(F.col("every_") > 0, F.lit(100.0) * F.col("total_ns") / F.col("every_")).otherwise(0.0)}).drop("every_")


def sorted_hotspots(spans: DataFrame, by: str = "total_ns", n: int = 20) -> DataFrame:
    """Hotspots by any of their measures."""
    return hotspots(spans).orderBy(F.desc(by), "category", "name").limit(n)


def by_category(spans: DataFrame) -> DataFrame:
    return spans.groupBy("category").agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"))


def top_hotspots(spans: DataFrame, n: int = 10, category: str | None = None, min_duration_ms: float | None = None) -> DataFrame:
    """The heaviest (name, category) pairs with their share of the wall time and the tags of their first tagged span."""
    found = S.select(spans, category, None, min_duration_ms)
    first_tags = F.min_by(S.without_link_tags(), F.when(F.size("tags") > 0, F.col("seq"))).alias("tags")
    by = found.groupBy("name", "category").agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.max("duration_ns").alias("max_ns"), first_tags)
    top = by.orderBy(F.desc("total_ns"), "name", "category").limit(n)
    return S.with_wall(top, spans).withColumns({"avg_ns": F.col("total_ns") / F.col("count"), "pct_wall": F.lit(100.0) * F.col("total_ns") / F.col("wall_ns")}).drop("wall_ns")


def kernel_details(spans: DataFrame, name: str) -> DataFrame:
    """Statistics of all spans whose name holds ``name``; percentiles are picked by position (n // 2 and n * 9 // 10 from 0)."""
    found = S.select(spans, name_contains=name).withColumn("all_", F.lit(""))
    stats = found.groupBy("all_").agg(
        F.count("*").alias("match_count"), F.sum("duration_ns").alias("total_ns"), F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns"),
        F.count_distinct("category").alias("n_categories"),
    )
    ninety = lambda n: F.least(n - 1, F.floor(n * 0.9))
    ranks = pick(found, "all_", "duration_ns", {"p50_ns": lambda n: F.floor(n / 2), "p90_ns": ninety})
    out = S.with_wall(stats.join(ranks, "all_"), spans)
    return out.select("match_count", "total_ns", "min_ns", "max_ns", "p50_ns", "p90_ns", "n_categories", (F.col("total_ns") / F.col("match_count")).alias("avg_ns"), (F.lit(100.0) * F.col("total_ns") / F.col("wall_ns")).alias("pct_wall"))


def representative_tags(spans: DataFrame, name: str, first: int = 5) -> DataFrame:
    """key, value: tags of the first matching spans, the earliest value of each key."""
    some = S.select(spans, name_contains=name).orderBy("seq").limit(first)
    rows = some.select("seq", F.explode(S.without_link_tags()).alias("key", "value"))
    return rows.groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def launched_from(spans: DataFrame, name: str, n: int = 3) -> DataFrame:
    """Names of the spans that matching spans were launched from, in order of appearance."""
    found = S.select(S.with_parent(spans), name_contains=name).where("parent_name is not null")
    return found.groupBy("parent_name").agg(F.min("seq").alias("first_seq")).orderBy("first_seq").limit(n)


def category_overview(spans: DataFrame, last: int = 14) -> DataFrame:
    """Share, mean, p99 (picked by position) and the latest durations of each category."""
    w = Window.partitionBy("category")
    p99 = pick(spans, "category", "duration_ns", {"p99_ns": lambda n: F.least(F.floor(n * 0.99), n - 1)})
    # Spark keeps the first ranks of each partition before it shuffles
    recent = spans.select("category", "seq", "duration_ns").withColumn("k", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("k") <= last)
    recent = recent.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "duration_ns"))), lambda x: x["duration_ns"]).alias("recent"))
    out = S.with_sum(by_category(spans), "total_ns")
    out = out.withColumns({"pct": F.lit(100.0) * F.col("total_ns") / F.col("every_"), "avg_ns": F.col("total_ns") / F.col("count")}).drop("every_")
    return out.join(p99, "category").join(recent, "category")


def sample_counts(spans: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent names among samples without duration."""
    rows = spans.where("category = 'cpu'").groupBy("name").agg(F.count("*").alias("samples"), F.sum("duration_ns").alias("total_ns"))
    return rows.where("total_ns = 0").select("name", "samples").orderBy(F.desc("samples"), "name").limit(n)


def flat_flame(spans: DataFrame, n: int = 30) -> DataFrame:
    """Time by name, each span counting a nanosecond at least."""
    return spans.groupBy("name").agg(F.sum(F.greatest("duration_ns", F.lit(1))).alias("value"), F.count("*").alias("count")).orderBy(F.desc("value"), "name").limit(n)


def parallelism(spans: DataFrame) -> DataFrame:
    """Threads, their summed time and how busy they are on average."""
    one = spans.agg(F.count_distinct(F.when(F.col("tid") != 0, F.col("tid"))).alias("thread_count"), F.sum("duration_ns").alias("aggregate_ns"), F.count("*").alias("total_spans"))
    out = S.with_wall(one, spans)
    busy = F.when(F.col("thread_count") > 0, F.lit(100.0) * F.col("aggregate_ns") / (F.col("thread_count") * F.col("wall_ns")))
    return out.withColumn("efficiency_pct", busy)


def breakdown(spans: DataFrame) -> DataFrame:
    """Time by category; shares of the wall time, or of all thread time where several threads ran (GPU categories excepted)."""
    rows = by_category(spans).crossJoin(F.broadcast(parallelism(spans).select("thread_count", "aggregate_ns", "wall_ns")))
    rows = rows.where(F.lit(100.0) * F.col("total_ns") / F.col("wall_ns") >= 0.1)
    of_threads = (F.col("thread_count") > 1) & ~F.col("category").isin(GPU_TIMELINE)
    pct = F.when(of_threads, F.lit(100.0) * F.col("total_ns") / F.greatest("aggregate_ns", F.lit(1))).otherwise(F.lit(100.0) * F.col("total_ns") / F.col("wall_ns"))
    return rows.select("category", "count", "total_ns", pct.alias("pct"), F.when(of_threads, "thread_aggregate").otherwise("wall_time").alias("pct_of"))


def context_hotspots(spans: DataFrame, n: int = 15) -> DataFrame:
    """The heaviest hotspots with the key tags of their first span, in the denominators of ``breakdown``."""
    tags = F.min_by(S.key_tags(), "seq").alias("tags")
    by = spans.groupBy("category", "name").agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), tags).orderBy(F.desc("total_ns"), "category", "name").limit(n)
    rows = by.crossJoin(F.broadcast(parallelism(spans).select("thread_count", "aggregate_ns", "wall_ns")))
    of_threads = (F.col("thread_count") > 1) & ~F.col("category").isin(GPU_TIMELINE) & (F.col("aggregate_ns") > 0)
    pct = F.when(of_threads, F.lit(100.0) * F.col("total_ns") / F.col("aggregate_ns")).otherwise(F.lit(100.0) * F.col("total_ns") / F.col("wall_ns"))
    return rows.select("category", "name", "count", "total_ns", (F.col("total_ns") / F.col("count")).alias("avg_ns"), pct.alias("pct"), "tags")


def rollup(spans: DataFrame) -> DataFrame:
    """Totals by (category, name), by category and overall."""
    return spans.rollup("category", "name").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"))


def approximate_percentiles(spans: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Approximate p50, p90 and p99 by category, in one pass with bounded sketches."""
    p = F.percentile_approx("duration_ns", [0.5, 0.9, 0.99], accuracy)
    return spans.groupBy("category").agg(p.alias("p")).select("category", F.col("p")[0].alias("p50_ns"), F.col("p")[1].alias("p90_ns"), F.col("p")[2].alias("p99_ns"))
