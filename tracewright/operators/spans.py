"""Projections, filters and queries over spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

LINK_TAGS = ["sid", "psid"]
KEY_TAGS = ["type", "grid", "block", "stream", "bytes", "dir", "count"]


def tag(key: str) -> Column:
    """A tag's value; null where there is none."""
    return F.element_at("tags", key)


def tag_bytes() -> Column:
    """The ``bytes`` tag as a number, 0 where it is missing or none."""
    return F.coalesce(tag("bytes").try_cast("double"), F.lit(0.0))


def derived(spans: DataFrame) -> DataFrame:
    """``spans`` with end, microsecond and millisecond columns."""
    end = F.col("start_ns") + F.col("duration_ns")
    return spans.withColumns(
        {"end_ns": end, "start_us": F.col("start_ns") / 1e3, "duration_us": F.col("duration_ns") / 1e3, "duration_ms": F.col("duration_ns") / 1e6}
    )


def wall(spans: DataFrame) -> DataFrame:
    """One row: wall_ns, the range from the first start to the last end (1 at least), and start_ns."""
    low = F.min("start_ns")
    return spans.agg(F.greatest(F.max("end_ns") - low, F.lit(1)).cast("bigint").alias("wall_ns"), low.alias("t0"))


def with_sum(groups: DataFrame, column: str) -> DataFrame:
    """``groups`` with the sum of a column over all of them as every_: one row, joined to each."""
    return groups.crossJoin(F.broadcast(groups.agg(F.sum(column).alias("every_"))))


def with_wall(df: DataFrame, spans: DataFrame) -> DataFrame:
    """``df`` with wall_ns; one row, so the join is a broadcast of a single value."""
    return df.crossJoin(F.broadcast(wall(spans)).select("wall_ns")) if "wall_ns" not in df.columns else df


def relative(spans: DataFrame) -> DataFrame:
    """Starts and ends counted from the trace's first start."""
    both = spans.crossJoin(F.broadcast(wall(spans)))
    return both.withColumn("start_ns", F.col("start_ns") - F.col("t0")).withColumn("end_ns", F.col("end_ns") - F.col("t0")).drop("t0")


def select(
    spans: DataFrame, category: str | None = None, name_contains: str | None = None, min_ms: float | None = None, max_ms: float | None = None,
    tags: dict[str, str] | None = None,
) -> DataFrame:
    """Spans by category, part of the name (any case), duration (inclusive) and tags."""
    if category:
        spans = spans.where(F.col("category") == category)
    if name_contains:
        spans = spans.where(F.lower("name").contains(name_contains.lower()))
    if min_ms is not None:
        spans = spans.where(F.col("duration_ns") >= min_ms * 1e6)
    if max_ms is not None:
        spans = spans.where(F.col("duration_ns") <= max_ms * 1e6)
    for key, value in (tags or {}).items():
        spans = spans.where(tag(key) == value)
    return spans


def without_link_tags() -> Column:
    return F.map_filter("tags", lambda k, v: ~k.isin(LINK_TAGS))


def key_tags() -> Column:
    return F.map_filter("tags", lambda k, v: k.isin(KEY_TAGS))


def visible(spans: DataFrame, low_ns: int, high_ns: int) -> DataFrame:
    """Spans that overlap a window; the bound on starts reaches the scan."""
    return spans.where((F.col("start_ns") < high_ns) & (F.col("end_ns") > low_ns))


def at_point(spans: DataFrame, at_ns: int) -> DataFrame:
    """The shortest span that holds a point in time, of each thread."""
    inside = spans.where((F.col("start_ns") <= at_ns) & (F.col("end_ns") >= at_ns))
    least = F.min_by(F.struct("seq", "name", "category", "start_ns", "duration_ns"), F.struct("duration_ns", "seq")).alias("s")
    return inside.groupBy("pid", "tid").agg(least).select("pid", "tid", "s.*")


def listed(spans: DataFrame, filtering: bool = False) -> DataFrame:
    """Spans for a table: samples without duration are left out unless one filters by name."""
    return spans if filtering else spans.where(~((F.col("category") == "cpu") & (F.col("duration_ns") == 0)))


def timed(spans: DataFrame) -> DataFrame:
    """The spans a view covers: those with a duration, or all if none has."""
    some = spans.agg(F.max("duration_ns").alias("longest"))
    return spans.crossJoin(F.broadcast(some)).where((F.col("duration_ns") > 0) | (F.col("longest") <= 0)).drop("longest")


def view_window(spans: DataFrame) -> DataFrame:
    """First start and last end of timed spans, of all if none is timed."""
    has = F.col("duration_ns") > 0
    return spans.agg(
        F.coalesce(F.min(F.when(has, F.col("start_ns"))), F.min("start_ns")).alias("start_ns"),
        F.coalesce(F.max(F.when(has, F.col("end_ns"))), F.max("end_ns")).alias("end_ns"),
    )


def top_spans(spans: DataFrame, n: int = 20) -> DataFrame:
    """The longest spans; a heap per partition, no full sort."""
    return spans.orderBy(F.desc("duration_ns"), "seq").limit(n)


def ids(spans: DataFrame) -> DataFrame:
    """span_id and the name and so on of its last span; ids may repeat, the latest counts."""
    last = F.max_by(F.struct("name", "category", "duration_ns", "pid", "tid"), "seq").alias("s")
    return spans.where("span_id is not null and span_id <> ''").groupBy("span_id").agg(last)


def with_parent(spans: DataFrame) -> DataFrame:
    """``spans`` with ``parent_name`` (null where the parent isn't in the trace)."""
    parent = ids(spans).select(F.col("span_id").alias("parent_span_id"), F.col("s.name").alias("parent_name"))
    return spans.join(parent, "parent_span_id", "left")


SORTS = {"duration": ("duration_ns", False), "start_time": ("start_ns", True), "name": ("name", True)}


def query(
    spans: DataFrame, category: str | None = None, name_contains: str | None = None, min_duration_ms: float | None = None, max_duration_ms: float | None = None,
    sort_by: str = "duration", limit: int = 20, include_tags: bool = True,
) -> DataFrame:
    """Spans that match, sorted and cut, with their share of the wall time and their parent's name."""
    found = select(spans, category, name_contains, min_duration_ms, max_duration_ms)
    column, rising = SORTS.get(sort_by, SORTS["duration"])
    order = F.asc(column) if rising else F.desc(column)
    cut = found.orderBy(order, "seq").limit(limit)
    parent = ids(spans).select(F.col("span_id").alias("parent_span_id"), F.col("s.name").alias("parent_name"))
    out = with_wall(cut.join(parent, "parent_span_id", "left"), spans)
    unknown = F.when(F.coalesce("parent_span_id", F.lit("")) != "", F.concat(F.lit("sid:"), F.left("parent_span_id", F.lit(8))))
    cols = [F.col("seq"), F.col("name"), F.col("category"), F.col("duration_ns"), F.col("start_ns"), (100.0 * F.col("duration_ns") / F.col("wall_ns")).alias("pct_wall"), F.coalesce("parent_name", unknown).alias("parent")]
    return out.select(*cols, *([without_link_tags().alias("tags")] if include_tags else []))


def total_matching(spans: DataFrame, **filters) -> DataFrame:  # noqa: ANN003
    return select(spans, **filters).agg(F.count("*").alias("total_matching"))


def lane() -> Column:
    """The row of a timeline a span belongs to."""
    stream = tag("stream")
    gpu = F.col("category").isin("cuda", "rocm") & (F.coalesce(stream, F.lit("")) != "")
    return (
        F.when(gpu, F.concat("category", F.lit("/stream-"), stream))
        .when(F.col("tid") != 0, F.concat("category", F.lit("/thread-"), F.col("tid").cast("string")))
        .otherwise(F.col("category"))
    )


def frames(spans: DataFrame) -> DataFrame:
    """One row per stack frame: symbol, library, offset."""
    rows = spans.select("seq", F.posexplode("stack_frames").alias("pos", "frame"))
    return rows.select("seq", "pos", names.frame_symbol(F.col("frame")).alias("symbol"), names.frame_library(F.col("frame")).alias("library"), names.frame_offset(F.col("frame")).alias("offset"))
