"""Named analyses over the driver's tables, each with the same question in SQL for DuckDB.

Array results are joined to text so that both engines compare alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, hotspots, intervals
from ..operators import spans as S
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str) -> Callable:
    """Register a query; ``sql`` may use the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{V.duck(*tables)}\n{sql}" if tables else sql
        return f

    return add


# ------------------------------------------------------------------ aggregation over spans

query(
    "hotspots",
    """SELECT category, name, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns,
  cast(sum(duration_ns) AS bigint) / count(*) AS avg_ns, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / cast(sum(sum(duration_ns)) OVER () AS bigint) AS pct
FROM spans GROUP BY category, name""",
    "spans",
)(lambda s, d: hotspots.hotspots(V.spans(s, d)))

query(
    "sorted_hotspots",
    """SELECT category, name, count(*) AS count, max(duration_ns) AS max_ns FROM spans GROUP BY category, name ORDER BY max_ns DESC, category, name LIMIT 20""",
    "spans",
)(lambda s, d: hotspots.sorted_hotspots(V.spans(s, d), "max_ns").select("category", "name", "count", "max_ns"))

query("spans_by_category", "SELECT category, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns FROM spans GROUP BY category", "spans")(lambda s, d: hotspots.by_category(V.spans(s, d)))

query(
    "tool_hotspots",
    """, g AS (SELECT name, category, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, max(duration_ns) AS max_ns, arg_min(t_type, CASE WHEN t_type IS NOT NULL OR t_bytes IS NOT NULL THEN seq END) AS type
  FROM spans WHERE category = 'cuda' AND duration_ns >= 5000000000 GROUP BY name, category ORDER BY total_ns DESC, name, category LIMIT 10)
SELECT g.*, total_ns / count AS avg_ns, cast(100 AS double) * total_ns / wall_ns AS pct_wall FROM g, wall""",
    "spans", "wall",
)(lambda s, d: hotspots.top_hotspots(V.spans(s, d), 10, "cuda", 5000.0).select("name", "category", "count", "total_ns", "max_ns", F.element_at("tags", "type").alias("type"), "avg_ns", "pct_wall"))

query(
    "kernel_details",
    """, m AS (SELECT duration_ns, category, row_number() OVER (ORDER BY duration_ns) - 1 AS r, count(*) OVER () AS n FROM spans WHERE contains(lower(name), 'kernel_1'))
SELECT count(*) AS match_count, cast(sum(duration_ns) AS bigint) AS total_ns, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns, max(CASE WHEN r = n // 2 THEN duration_ns END) AS p50_ns,
  max(CASE WHEN r = least(n - 1, cast(floor(n * 0.9) AS bigint)) THEN duration_ns END) AS p90_ns, count(DISTINCT category) AS n_categories, cast(sum(duration_ns) AS bigint) / count(*) AS avg_ns,
  cast(100 AS double) * cast(sum(duration_ns) AS bigint) / max(wall_ns) AS pct_wall FROM m, wall""",
    "spans", "wall",
)(lambda s, d: hotspots.kernel_details(V.spans(s, d), "Kernel_1"))

query(
    "representative_tags",
    """, f AS (SELECT * FROM spans WHERE contains(name, 'copy_') ORDER BY seq LIMIT 5), t AS (SELECT seq, 'type' AS key, t_type AS value FROM f UNION ALL SELECT seq, 'bytes', t_bytes FROM f)
SELECT key, arg_min(value, seq) AS value FROM t WHERE value IS NOT NULL GROUP BY key""",
    "spans",
)(lambda s, d: hotspots.representative_tags(V.spans(s, d), "copy_"))

_PARENT = ", ids AS (SELECT span_id AS pid_, name AS parent_name, category AS parent_category, duration_ns AS parent_ns, pid AS ppid, tid AS ptid FROM spans)"
query(
    "launched_from",
    _PARENT + " SELECT parent_name, min(seq) AS first_seq FROM spans JOIN ids ON parent_span_id = pid_ WHERE contains(name, 'kernel_') GROUP BY parent_name ORDER BY first_seq LIMIT 3",
    "spans",
)(lambda s, d: hotspots.launched_from(V.spans(s, d), "kernel_"))

query(
    "category_overview",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY duration_ns) - 1 AS r, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY seq DESC) AS k FROM spans)
SELECT category, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / cast(sum(sum(duration_ns)) OVER () AS bigint) AS pct,
  cast(sum(duration_ns) AS bigint) / count(*) AS avg_ns, max(CASE WHEN r = least(cast(floor(n * 0.99) AS bigint), n - 1) THEN duration_ns END) AS p99_ns,
  string_agg(CASE WHEN k <= 14 THEN cast(duration_ns AS varchar) END, ',' ORDER BY seq) AS recent FROM r GROUP BY category""",
    "spans",
)(lambda s, d: hotspots.category_overview(V.spans(s, d)).withColumn("recent", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",")))

query("flat_flame", "SELECT name, cast(sum(greatest(duration_ns, 1)) AS bigint) AS value, count(*) AS count FROM spans GROUP BY name ORDER BY value DESC, name LIMIT 30", "spans")(lambda s, d: hotspots.flat_flame(V.spans(s, d)))

query(
    "parallelism",
    "SELECT count(DISTINCT CASE WHEN tid <> 0 THEN tid END) AS thread_count, cast(sum(duration_ns) AS bigint) AS aggregate_ns, count(*) AS total_spans, max(wall_ns) AS wall_ns, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / (count(DISTINCT CASE WHEN tid <> 0 THEN tid END) * max(wall_ns)) AS efficiency_pct FROM spans, wall",
    "spans", "wall",
)(lambda s, d: hotspots.parallelism(V.spans(s, d)))

query(
    "category_breakdown",
    """, c AS (SELECT category, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns FROM spans GROUP BY category), p AS (SELECT count(DISTINCT CASE WHEN tid <> 0 THEN tid END) AS tc, cast(sum(duration_ns) AS bigint) AS agg FROM spans)
SELECT category, count, total_ns, CASE WHEN tc > 1 AND category NOT IN ('cuda', 'rocm') THEN cast(100 AS double) * total_ns / greatest(agg, 1) ELSE cast(100 AS double) * total_ns / wall_ns END AS pct,
  CASE WHEN tc > 1 AND category NOT IN ('cuda', 'rocm') THEN 'thread_aggregate' ELSE 'wall_time' END AS pct_of FROM c, p, wall WHERE cast(100 AS double) * total_ns / wall_ns >= 0.1""",
    "spans", "wall",
)(lambda s, d: hotspots.breakdown(V.spans(s, d)))

query(
    "context_hotspots",
    """, g AS (SELECT category, name, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, arg_min(coalesce(t_type, '-'), seq) AS type FROM spans GROUP BY category, name ORDER BY total_ns DESC, category, name LIMIT 15), p AS (SELECT cast(sum(duration_ns) AS bigint) AS agg FROM spans)
SELECT category, name, count, total_ns, total_ns / count AS avg_ns, CASE WHEN category NOT IN ('cuda', 'rocm') THEN cast(100 AS double) * total_ns / agg ELSE cast(100 AS double) * total_ns / wall_ns END AS pct, type FROM g, p, wall""",
    "spans", "wall",
)(lambda s, d: hotspots.context_hotspots(V.spans(s, d)).withColumn("type", F.coalesce(F.element_at("tags", "type"), F.lit("-"))).drop("tags"))

query("rollup", "SELECT category, name, cast(grouping(category, name) AS integer) AS level, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns FROM spans GROUP BY ROLLUP (category, name)", "spans")(lambda s, d: hotspots.rollup(V.spans(s, d)))

query("top_spans", "SELECT seq, name, duration_ns FROM spans ORDER BY duration_ns DESC, seq LIMIT 20", "spans")(lambda s, d: S.top_spans(V.spans(s, d)).select("seq", "name", "duration_ns"))

query(
    "query_spans",
    _PARENT + """, q AS (SELECT * FROM spans WHERE category = 'cuda' AND contains(lower(name), 'kernel') AND duration_ns >= 10000000000 AND duration_ns <= 100000000000 ORDER BY start_ns, seq LIMIT 50)
SELECT seq, name, category, duration_ns, start_ns, cast(100 AS double) * duration_ns / wall_ns AS pct_wall, CASE WHEN coalesce(parent_span_id, '') <> '' THEN coalesce(parent_name, 'sid:' || left(parent_span_id, 8)) END AS parent, t_type AS type
FROM q LEFT JOIN ids ON parent_span_id = pid_, wall""",
    "spans", "wall",
)(lambda s, d: S.query(V.spans(s, d), "cuda", "Kernel", 10000.0, 100000.0, "start_time", 50).withColumn("type", F.element_at("tags", "type")).drop("tags"))

query("total_matching", "SELECT count(*) AS total_matching FROM spans WHERE category = 'mpi' AND duration_ns >= 1000000000", "spans")(lambda s, d: S.total_matching(V.spans(s, d), category="mpi", min_ms=1000.0))
query("derived_times", "SELECT seq, start_ns + duration_ns AS end_ns, start_ns / 1000 AS start_us, duration_ns / 1000 AS duration_us, duration_ns / 1000000 AS duration_ms FROM spans", "spans")(lambda s, d: S.derived(V.spans(s, d)).select("seq", "end_ns", "start_us", "duration_us", "duration_ms"))
query("tag_filter", "SELECT seq, name, t_stream AS stream FROM spans WHERE t_type = 'kernel' AND t_stream = '2'", "spans")(lambda s, d: S.select(V.spans(s, d), tags={"type": "kernel", "stream": "2"}).select("seq", "name", S.tag("stream").alias("stream")))
query("visible_spans", "SELECT seq FROM spans WHERE start_ns < 1704672000000000000 AND end_ns > 1704585600000000000", "spans")(lambda s, d: S.visible(V.spans(s, d), 1704585600000000000, 1704672000000000000).select("seq"))
query(
    "span_at_point",
    "SELECT pid, tid, seq, name, category, start_ns, duration_ns FROM spans WHERE start_ns <= 1704672000000000000 AND end_ns >= 1704672000000000000 QUALIFY row_number() OVER (PARTITION BY pid, tid ORDER BY duration_ns, seq) = 1",
    "spans",
)(lambda s, d: S.at_point(V.spans(s, d), 1704672000000000000))
query("with_parent", _PARENT + " SELECT seq, parent_name FROM spans LEFT JOIN ids ON parent_span_id = pid_", "spans")(lambda s, d: S.with_parent(V.spans(s, d)).select("seq", "parent_name"))
query("view_window", "SELECT min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM spans WHERE duration_ns > 0", "spans")(lambda s, d: S.view_window(V.spans(s, d)))
query("listed_spans", "SELECT count(*) AS n FROM spans WHERE NOT (category = 'cpu' AND duration_ns = 0)", "spans")(lambda s, d: S.listed(V.spans(s, d)).agg(F.count("*").alias("n")))
query("tag_subset", "SELECT seq, concat_ws(',', 'bytes=' || t_bytes, 'type=' || t_type) AS tags FROM spans WHERE category = 'memory'", "spans")(
    lambda s, d: V.spans(s, d).where("category = 'memory'").select("seq", F.array_join(F.array_sort(F.transform(F.map_entries(S.key_tags()), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("tags"))
)

# ------------------------------------------------------------------ activity

query(
    "memory_profile",
    """SELECT coalesce(t_type, name) AS operation, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, sum(coalesce(try_cast(t_bytes AS double), 0)) AS total_bytes, cast(sum(duration_ns) AS bigint) / count(*) AS avg_ns,
  CASE WHEN sum(coalesce(try_cast(t_bytes AS double), 0)) > 0 AND sum(duration_ns) > 0 THEN sum(coalesce(try_cast(t_bytes AS double), 0)) / cast(sum(duration_ns) AS bigint) END AS bandwidth_gbs FROM spans WHERE category = 'memory' GROUP BY 1""",
    "spans",
)(lambda s, d: activity.memory_profile(V.spans(s, d)))
query(
    "memory_profile_all",
    "SELECT coalesce(t_type, name) AS operation, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns FROM spans WHERE category = 'memory' OR t_type IN ('memcpy', 'memcpy_async', 'HtoD', 'DtoH') GROUP BY 1",
    "spans",
)(lambda s, d: activity.memory_profile(V.spans(s, d), True).select("operation", "count", "total_ns"))
query("memory_transfers", "SELECT count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, sum(coalesce(try_cast(t_bytes AS double), 0)) AS total_bytes, sum(coalesce(try_cast(t_bytes AS double), 0)) / cast(sum(duration_ns) AS bigint) AS bandwidth_gbs FROM spans WHERE category = 'memory'", "spans")(
    lambda s, d: activity.transfers(V.spans(s, d))
)
query(
    "sync_analysis",
    _PARENT + """, r AS (SELECT name, duration_ns, parent_name FROM spans LEFT JOIN ids ON parent_span_id = pid_ WHERE category = 'sync'),
p AS (SELECT name, string_agg(parent_name, ',' ORDER BY parent_name) AS waiting_for FROM (SELECT DISTINCT name, parent_name FROM r WHERE parent_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY parent_name) <= 3) GROUP BY name)
SELECT name, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / cast(sum(sum(duration_ns)) OVER () AS bigint) AS pct_of_sync, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / max(wall_ns) AS pct_wall, max(waiting_for) AS waiting_for
FROM r LEFT JOIN (SELECT name AS n2, waiting_for FROM p) ON name = n2, wall GROUP BY name""".replace("SELECT DISTINCT name, parent_name FROM r WHERE parent_name IS NOT NULL QUALIFY", "SELECT name, parent_name FROM (SELECT DISTINCT name, parent_name FROM r WHERE parent_name IS NOT NULL) QUALIFY"),
    "spans", "wall",
)(lambda s, d: activity.sync_analysis(V.spans(s, d)).withColumn("waiting_for", F.array_join("waiting_for", ",")))
query(
    "mpi_communication",
    "SELECT name, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, sum(coalesce(try_cast(t_bytes AS double), 0)) AS total_bytes, bool_or(coalesce(parent_span_id, '') <> '') AS linked, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / max(wall_ns) AS pct_wall FROM spans, wall WHERE category = 'mpi' GROUP BY name",
    "spans", "wall",
)(lambda s, d: activity.mpi_communication(V.spans(s, d)))
query(
    "request_pairs",
    "SELECT count(*) AS linked_pairs FROM (SELECT span_id FROM spans WHERE category = 'mpi' AND contains(lower(name), 'isend') INTERSECT SELECT parent_span_id FROM spans WHERE category = 'mpi')",
    "spans",
)(lambda s, d: activity.request_pairs(V.spans(s, d)))
query("counter_last", "SELECT name, arg_max(value, seq) AS value FROM counters GROUP BY name", "counters")(lambda s, d: activity.last_values(V.counters(s, d)))
query("counter_peaks", r"SELECT CASE WHEN regexp_extract(name, '\[(?:gpu)?([^\]]*)\]', 1) = '' THEN '0' ELSE regexp_extract(name, '\[(?:gpu)?([^\]]*)\]', 1) END AS label, max(value) AS peak FROM counters WHERE starts_with(name, 'view') GROUP BY 1", "counters")(
    lambda s, d: activity.peaks(V.counters(s, d), "view")
)
query("counter_series", "SELECT name, row_number() OVER (PARTITION BY name ORDER BY timestamp_ns, seq) AS pos, timestamp_ns, value FROM counters", "counters")(
    lambda s, d: activity.series(V.counters(s, d)).withColumn("pos", F.col("pos").cast("bigint"))
)
query("kernel_active", "SELECT category, cast(sum(duration_ns) AS bigint) AS kernel_ns, cast(100 AS double) * cast(sum(duration_ns) AS bigint) / max(wall_ns) AS active_pct FROM spans, wall WHERE category IN ('cuda', 'rocm') AND t_type = 'kernel' GROUP BY category", "spans", "wall")(
    lambda s, d: activity.kernel_active(V.spans(s, d))
)
query(
    "gpu_efficiency",
    """, e AS (SELECT cast(sum(duration_ns) FILTER (category = 'cuda' AND t_type = 'kernel') AS bigint) AS active_ns, cast(sum(duration_ns) FILTER (category = 'sync') AS bigint) AS sync_ns FROM spans), p AS (SELECT *, cast(100 AS double) * active_ns / (active_ns + sync_ns) AS efficiency_pct FROM e)
SELECT *, CASE WHEN efficiency_pct >= 85 THEN 'A+' WHEN efficiency_pct >= 70 THEN 'A' WHEN efficiency_pct >= 55 THEN 'B' WHEN efficiency_pct >= 35 THEN 'C' WHEN efficiency_pct >= 15 THEN 'D' ELSE 'F' END AS grade FROM p""",
    "spans",
)(lambda s, d: activity.gpu_efficiency(V.spans(s, d)))
_UNION = "(SELECT cast(coalesce(sum(greatest(0, end_ns - greatest(start_ns, coalesce(seen, start_ns)))), 0) AS bigint) FROM (SELECT start_ns, end_ns, max(end_ns) OVER (ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {}))"
query(
    "gpu_starvation",
    f""", work AS (SELECT start_ns, end_ns FROM spans WHERE category IN ('cuda', 'rocm', 'opencl') AND (coalesce(t_type = 'kernel', false) OR t_side IS NULL OR t_side = 'gpu')),
stall AS (SELECT start_ns, end_ns, duration_ns FROM spans WHERE name IN ('cudaDeviceSynchronize', 'cudaStreamSynchronize', 'clFinish') AND duration_ns > 0), busy AS (SELECT * FROM work UNION ALL SELECT start_ns, end_ns FROM stall),
o AS (SELECT wall_ns, {_UNION.format('work')} AS gpu_active_ns, {_UNION.format('busy')} AS busy_ns, (SELECT cast(sum(duration_ns) AS bigint) FROM stall) AS sync_stall_ns, (SELECT count(*) FROM stall) AS sync_calls FROM wall),
g AS (SELECT *, greatest(0, wall_ns - gpu_active_ns - sync_stall_ns) AS launch_gap_ns, wall_ns - busy_ns AS gap_exact_ns FROM o), p AS (SELECT *, cast(100 AS double) * gpu_active_ns / wall_ns AS gpu_active_pct, cast(100 AS double) * sync_stall_ns / wall_ns AS sync_stall_pct, cast(100 AS double) * launch_gap_ns / wall_ns AS launch_gap_pct FROM g)
SELECT * EXCLUDE (busy_ns), CASE WHEN sync_stall_pct > 20 THEN 'sync' WHEN launch_gap_pct > 30 THEN 'launch_gap' ELSE 'none' END AS advice FROM p""",
    "spans", "wall",
)(lambda s, d: activity.gpu_starvation(V.spans(s, d)))

# ------------------------------------------------------------------ time

query(
    "interval_union",
    "SELECT category, cast(sum(greatest(0, end_ns - greatest(start_ns, coalesce(seen, start_ns)))) AS bigint) AS union_ns FROM (SELECT category, start_ns, end_ns, max(end_ns) OVER (PARTITION BY category ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM spans WHERE end_ns > start_ns) GROUP BY category",
    "spans",
)(lambda s, d: intervals.union_length(V.spans(s, d), ["category"]))
_BUCKETS = """, w AS (SELECT wall_ns // 10 AS b0, wall_ns, t0 FROM wall), z AS (SELECT CASE WHEN (wall_ns + b0 - 1) // b0 > 20 THEN (wall_ns + 19) // 20 ELSE b0 END AS width, least(20, (wall_ns + b0 - 1) // b0) AS n, t0 FROM w),
x AS (SELECT category, start_ns - t0 AS s, end_ns - t0 AS e, width, unnest(generate_series(greatest(0, (start_ns - t0) // width), least(n - 1, (end_ns - t0) // width))) AS bucket FROM spans, z WHERE duration_ns > 0),
o AS (SELECT bucket, category, max(width) AS width, cast(sum(least(e, (bucket + 1) * width) - greatest(s, bucket * width)) AS bigint) AS busy_ns FROM x WHERE least(e, (bucket + 1) * width) > greatest(s, bucket * width) GROUP BY bucket, category)"""
query(
    "timeline_phases",
    _BUCKETS + """, k AS (SELECT *, cast(100 AS double) * busy_ns / width AS pct FROM o WHERE cast(100 AS double) * busy_ns / width >= 0.95), every AS (SELECT unnest(generate_series(0, n - 1)) AS bucket, width FROM z)
SELECT every.bucket, every.bucket * every.width AS from_ns, coalesce(category, 'idle') AS category, coalesce(busy_ns, every.width) AS busy_ns, coalesce(pct, 100) AS pct FROM every LEFT JOIN k ON k.bucket = every.bucket""",
    "spans", "wall",
)(lambda s, d: intervals.timeline_phases(V.spans(s, d)))
_LANE = "CASE WHEN category IN ('cuda', 'rocm') AND coalesce(t_stream, '') <> '' THEN category || '/stream-' || t_stream WHEN tid <> 0 THEN category || '/thread-' || cast(tid AS varchar) ELSE category END"
query("lanes", f"SELECT {_LANE} AS lane, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM spans GROUP BY 1", "spans")(lambda s, d: intervals.lanes(V.spans(s, d)))
query(
    "lane_order",
    f""", r AS (SELECT {_LANE} AS lane, min(tid) AS tid, min(t_stream) AS stream FROM spans GROUP BY 1), k AS (SELECT *, CASE WHEN contains(lane, '/stream-') THEN 'stream' WHEN contains(lane, '/thread-') THEN 'thread' ELSE 'plain' END AS kind FROM r),
n AS (SELECT *, dense_rank() OVER (PARTITION BY kind ORDER BY tid) AS d FROM k) SELECT lane, kind, cast(CASE kind WHEN 'plain' THEN -1 WHEN 'thread' THEN d ELSE 10000 + coalesce(try_cast(stream AS integer), 0) END AS integer) AS place, CASE kind WHEN 'thread' THEN 'T' || cast(d AS varchar) ELSE lane END AS label FROM n""",
    "spans",
)(lambda s, d: intervals.lane_order(V.spans(s, d)))
query("name_colours", "SELECT name, cast((row_number() OVER (ORDER BY min(seq)) - 1) % 16 AS integer) AS colour FROM spans GROUP BY name", "spans")(lambda s, d: intervals.colours(V.spans(s, d)))
query(
    "lane_density",
    f""", v AS (SELECT min(start_ns) AS low, max(end_ns) AS high FROM spans WHERE duration_ns > 0), p AS (SELECT low, high, greatest(1, (high - low + 199) // 200) AS px FROM v),
r AS (SELECT {_LANE} AS lane, name, seq, greatest(start_ns, low) AS s, least(end_ns, high) AS e, low, px FROM spans, p WHERE duration_ns > 0 AND start_ns < high AND end_ns > low),
x AS (SELECT *, unnest(generate_series((s - low) // px, (e - low - 1) // px)) AS pixel FROM r)
SELECT lane, pixel, least(1.0, cast(sum(least(e, low + (pixel + 1) * px) - greatest(s, low + pixel * px)) AS bigint) / cast(max(px) AS double)) AS coverage, arg_max(name, (s, seq)) AS name FROM x GROUP BY lane, pixel""",
    "spans",
)(lambda s, d: intervals.density(V.spans(s, d), 200))
query(
    "lane_utilisation",
    f""", l AS (SELECT {_LANE} AS lane, start_ns, end_ns FROM spans WHERE duration_ns > 0), u AS (SELECT lane, start_ns, end_ns, max(end_ns) OVER (PARTITION BY lane ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l)
SELECT lane, cast(sum(greatest(0, end_ns - greatest(start_ns, coalesce(seen, start_ns)))) AS bigint) AS union_ns, cast(100 AS double) * cast(sum(greatest(0, end_ns - greatest(start_ns, coalesce(seen, start_ns)))) AS bigint) / (SELECT max(end_ns) - min(start_ns) FROM l) AS busy_pct FROM u GROUP BY lane""",
    "spans",
)(lambda s, d: intervals.lane_utilisation(V.spans(s, d)))
query("ruler", "SELECT cast(t AS integer) AS tick, cast(floor(t * ((max(end_ns) - min(start_ns)) / 10)) AS bigint) AS offset_ns FROM spans, generate_series(0, 10) g(t) WHERE duration_ns > 0 GROUP BY t", "spans")(lambda s, d: intervals.ruler(V.spans(s, d)))


from . import catalog_formats, catalog_machine, catalog_records, catalog_streams, catalog_structure  # noqa: E402, F401
