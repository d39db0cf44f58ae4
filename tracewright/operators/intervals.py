"""Unions of intervals, overlaps with time buckets, lanes and their density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .ranges import running


def unions(rows: DataFrame, kinds: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Lengths of the unions of [start_ns, end_ns) by group, for each name of those rows for which its condition holds.

    In order of (start, end), an interval adds what reaches beyond the furthest end
    before it.  That is a running maximum over ranges of rows, so neither a group of
    any size nor a burst lands in one task, and all kinds take one pass.
    """
    by = by or []
    keyed = rows.where("end_ns > start_ns").select(*by, "start_ns", "end_ns", *[F.coalesce(c, F.lit(False)).alias(f"is_{n}") for n, c in kinds.items()])
    out = running(keyed, by, ["start_ns", "end_ns"], {n: ("max", F.when(F.col(f"is_{n}"), F.col("end_ns"))) for n in kinds}, before=True)
    added = lambda n: F.when(F.col(f"is_{n}"), F.greatest(F.lit(0), F.col("end_ns") - F.greatest("start_ns", F.coalesce(n, "start_ns"))))
    return out.groupBy(*by).agg(*[F.coalesce(F.sum(added(n)), F.lit(0)).cast("bigint").alias(n) for n in kinds])


def union_length(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Length of the union of [start_ns, end_ns) by group."""
    return unions(rows, {"union_ns": F.lit(True)}, by)


def buckets(spans: DataFrame, bucket_ms: float = 0.0, most: int = 20) -> tuple[int, int]:
    """Width and number of a timeline's buckets: a tenth of the wall time unless asked for, ``most`` of them at most."""
    wall_ns = S.wall(spans).first()["wall_ns"] or 1
    width = int(bucket_ms * 1e6) if bucket_ms > 0 else max(1, wall_ns // 10)
    n = max(1, -(-wall_ns // width))
    if n > most:
        width, n = -(-wall_ns // most), most
    return width, n


def bucket_overlap(spans: DataFrame, width: int, n: int, by: list[str]) -> DataFrame:
    """How long the spans of each group overlap each bucket; spans are exploded into the buckets they touch only."""
    rows = S.relative(spans.where("duration_ns > 0"))
    first = F.greatest(F.lit(0), F.floor(F.col("start_ns") / width)).cast("bigint")
    last = F.least(F.lit(n - 1), F.floor(F.col("end_ns") / width)).cast("bigint")
    rows = rows.where(first <= last).withColumn("bucket", F.explode(F.sequence(first, last)))
    low = F.col("bucket") * width
    overlap = F.least(F.col("end_ns"), low + width) - F.greatest(F.col("start_ns"), low)
    return rows.withColumn("overlap", overlap).where("overlap > 0").groupBy("bucket", *by).agg(F.sum("overlap").cast("bigint").alias("busy_ns"))


def timeline_phases(spans: DataFrame, bucket_ms: float = 0.0) -> DataFrame:
    """Share of each category in each bucket of time; empty buckets are idle."""
    width, n = buckets(spans, bucket_ms)
    rows = bucket_overlap(spans, width, n, ["category"]).withColumn("pct", F.lit(100.0) * F.col("busy_ns") / width).where("pct >= 0.95")
    every = spans.sparkSession.range(n).select(F.col("id").alias("bucket"))
    out = every.join(rows, "bucket", "left")
    return out.select("bucket", (F.col("bucket") * width).alias("from_ns"), F.coalesce("category", F.lit("idle")).alias("category"), F.coalesce("busy_ns", F.lit(width)).cast("bigint").alias("busy_ns"), F.coalesce("pct", F.lit(100.0)).alias("pct"))


def lanes(spans: DataFrame) -> DataFrame:
    """Number, time and extent of the spans of each lane."""
    return spans.groupBy(S.lane().alias("lane")).agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))


def lane_order(spans: DataFrame) -> DataFrame:
    """Threads numbered T1, T2, … by id, streams from 10000, other lanes first."""
    rows = spans.select(S.lane().alias("lane"), "tid", S.tag("stream").alias("stream")).withColumn("kind", F.when(F.col("lane").contains("/stream-"), "stream").when(F.col("lane").contains("/thread-"), "thread").otherwise("plain"))
    one = rows.groupBy("lane", "kind").agg(F.min("tid").alias("tid"), F.min("stream").alias("stream"))
    rank = running(one.select("kind", "tid").distinct(), ["kind"], ["tid"], {"number": ("sum", F.lit(1))}).select(F.col("kind").alias("k_"), F.col("tid").alias("t_"), "number")
    one = one.join(rank, F.col("kind").eqNullSafe(F.col("k_")) & F.col("tid").eqNullSafe(F.col("t_")))
    number = F.col("number")
    place = F.when(F.col("kind") == "plain", F.lit(-1)).when(F.col("kind") == "thread", number).otherwise(F.lit(10000) + F.coalesce(F.col("stream").try_cast("int"), F.lit(0)))
    return one.select("lane", "kind", place.cast("int").alias("place"), F.when(F.col("kind") == "thread", F.concat(F.lit("T"), number.cast("string"))).otherwise(F.col("lane")).alias("label"))


def colours(spans: DataFrame, n: int = 16) -> DataFrame:
    """A colour for each name, in order of first appearance."""
    first = spans.groupBy("name").agg(F.min("seq").alias("first_seq"))
    return running(first, [], ["first_seq"], {"place": ("sum", F.lit(1))}).select("name", ((F.col("place") - 1) % n).cast("int").alias("colour"))


def density(spans: DataFrame, width: int, low_ns: int | None = None, high_ns: int | None = None) -> DataFrame:
    """Coverage of each pixel of each lane (1 at most), and the name that started last before its end.

    Spans are clipped to the window and exploded into the pixels they touch, so
    the blow-up is bounded by ``width``.
    """
    ends = S.view_window(spans).first()
    low, high = low_ns if low_ns is not None else ends["start_ns"], high_ns if high_ns is not None else ends["end_ns"]
    px = max(1, -(-(high - low) // width)) if high is not None and low is not None else 1
    low, high = low or 0, high or 0
    rows = S.visible(spans.where("duration_ns > 0"), low, high).select(S.lane().alias("lane"), "name", "seq", F.greatest("start_ns", F.lit(low)).alias("s"), F.least("end_ns", F.lit(high)).alias("e"))
    rows = rows.withColumn("pixel", F.explode(F.sequence(F.floor((F.col("s") - low) / px), F.floor((F.col("e") - low - 1) / px))))
    at = F.lit(low) + F.col("pixel") * px
    cover = F.least(F.col("e"), at + px) - F.greatest(F.col("s"), at)
    by = rows.groupBy("lane", "pixel").agg(F.sum(cover).alias("ns"), F.max_by("name", F.struct("s", "seq")).alias("name"))
    return by.select("lane", F.col("pixel").cast("bigint"), F.least(F.lit(1.0), F.col("ns") / F.lit(float(px))).alias("coverage"), "name")


def lane_utilisation(spans: DataFrame) -> DataFrame:
    """Exact share of the view in which each lane is busy."""
    rows = S.timed(spans).select(S.lane().alias("lane"), "start_ns", "end_ns")
    total = S.view_window(spans).select((F.col("end_ns") - F.col("start_ns")).alias("view_ns"))
    out = union_length(rows, ["lane"]).crossJoin(F.broadcast(total))
    return out.select("lane", "union_ns", (F.lit(100.0) * F.col("union_ns") / F.greatest("view_ns", F.lit(1))).alias("busy_pct"))


def ruler(spans: DataFrame, ticks: int = 10) -> DataFrame:
    """Evenly spaced points of time over the view."""
    one = S.view_window(spans)
    step = (F.col("end_ns") - F.col("start_ns")) / F.lit(ticks)
    return one.select("start_ns", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(ticks))).alias("tick")).select("tick", F.floor(F.col("tick") * F.col("step")).cast("bigint").alias("offset_ns"))
