"""Streams over the tables, run until all there is has been read, and held against the tables.

Rows that wait for the watermark when a stream ends are not yet results; the SQL
leaves out what lies within the allowed lateness of the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import scratch_path
from ..streaming import ingest, pairing
from . import views as V
from .catalog import query


def _events(s: SparkSession, d: str) -> DataFrame:
    schema = V.load(s, d, "events").schema
    return s.readStream.schema(schema).parquet(f"{d.rstrip('/')}/event[s].parquet")  # a pattern, as streams read no single file by name


def _spans(s: SparkSession, d: str) -> DataFrame:
    return V._sql(s, d, V._SPANS, [], ev=V._sql(s, d, V._EVENTS, [], events=_events(s, d)))


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Records of a stream of events: a span each, broken ones among them, stacks, and counters."""
    span = F.concat_ws(":", F.lit("span"), "category", F.when(F.col("seq") % 50 == 7, "x").otherwise(F.col("pid").cast("string")), F.col("tid").cast("string"), F.col("start_ns").cast("string"), F.col("duration_ns").cast("string"), "name", F.concat(F.lit("type=t,sid="), "span_id"))
    stack = F.when(F.col("seq") % 3 == 0, F.concat_ws(":", F.lit("stk"), F.col("pid").cast("string"), F.col("tid").cast("string"), F.col("start_ns").cast("string"), F.lit("f;main")))
    counter = F.concat_ws(":", F.lit("ctr:memory:1"), F.col("start_ns").cast("string"), F.col("category"), F.col("tid").cast("string"), F.lit("u"))
    return _spans(s, d).select(F.explode(F.array_compact(F.array(span, stack, counter))).alias("value"))


def _run(s: SparkSession, out: DataFrame) -> DataFrame:
    """All finished rows of a stream."""
    path, checkpoint = scratch_path(s, "stream"), scratch_path(s, "stream-state")
    ingest.append(out, path, checkpoint).start().awaitTermination()
    return s.read.schema(out.schema).parquet(path)


query("stream_spans", "SELECT name, category, start_ns, duration_ns, pid, tid, span_id FROM spans WHERE seq % 50 <> 7", "spans")(lambda s, d: _run(s, ingest.spans(_lines(s, d))).select("name", "category", "start_ns", "duration_ns", "pid", "tid", "span_id"))
query(
    "stream_stacks",
    ", k AS (SELECT pid, tid, start_ns FROM spans WHERE seq % 3 = 0) SELECT p.span_id, 'f;main' AS stack FROM spans p JOIN k ON k.pid = p.pid AND k.tid = p.tid AND k.start_ns = p.start_ns WHERE p.seq % 50 <> 7",
    "spans",
)(lambda s, d: _run(s, ingest.attach(ingest.spans(_lines(s, d)), ingest.stacks(_lines(s, d)))).where("size(stack_frames) > 0").select("span_id", F.array_join("stack_frames", ";").alias("stack")))
_CLOSED = ", c AS (SELECT category AS name, cast(tid AS double) AS value, us FROM spans JOIN ev ON seq = event_id), m AS (SELECT max(us) - 10000000 AS mark FROM c)"
query(
    "stream_gauges",
    _CLOSED + " SELECT (us // 60000000) * 60000000 AS start_us, name, max(value) AS peak, count(*) AS points FROM c, m GROUP BY 1, 2, mark HAVING (us // 60000000 + 1) * 60000000 <= mark".replace("HAVING (us // 60000000 + 1) * 60000000", "HAVING start_us + 60000000"),
    "spans",
)(lambda s, d: _run(s, ingest.gauges(ingest.counters(_lines(s, d)), "1 minute")).select(F.unix_micros("start").alias("start_us"), "name", "peak", "points"))
query(
    "stream_phases",
    """, c AS (SELECT category, us, duration_ns FROM spans JOIN ev ON seq = event_id WHERE seq % 50 <> 7), m AS (SELECT max(us) - 10000000 AS mark FROM c),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY category ORDER BY us) < 3600000000 THEN 0 ELSE 1 END AS new FROM c), h AS (SELECT *, sum(new) OVER (PARTITION BY category ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT category, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS spans, cast(sum(duration_ns) AS bigint) AS total_ns FROM h, m GROUP BY category, n, mark HAVING max(us) + 3600000000 <= mark""",
    "spans",
)(lambda s, d: _run(s, ingest.phases(ingest.spans(_lines(s, d)), "1 hour")).select("category", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "spans", "total_ns"))


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    path, checkpoint = scratch_path(s, "stream"), scratch_path(s, "stream-state")
    table = lambda: V.instructions(s, d).groupBy((F.col("pos") % 7).alias("tid")).agg(F.count("*").alias("instructions"))
    stream = ingest.spans(_lines(s, d)).select("span_id", "tid")
    ingest.refreshed(stream, table, ["tid"], lambda df, n: df.write.mode("append").parquet(path), checkpoint).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(path)


query("stream_refreshed", ", i AS (SELECT p_partkey % 7 AS tid, count(*) AS instructions FROM part GROUP BY 1) SELECT span_id, spans.tid, instructions FROM spans LEFT JOIN i ON i.tid = spans.tid WHERE seq % 50 <> 7", "spans")(_refreshed)


def _hotspots(s: SparkSession, d: str) -> DataFrame:
    path, checkpoint = scratch_path(s, "stream"), scratch_path(s, "stream-state")
    out = ingest.on_batch(ingest.hotspots(ingest.spans(_lines(s, d))), lambda df, n: df.write.mode("overwrite").parquet(path), checkpoint)
    out.outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(path)


query("stream_hotspots", "SELECT category, name, count(*) AS count, cast(sum(duration_ns) AS bigint) AS total_ns, max(duration_ns) AS max_ns FROM spans WHERE seq % 50 <> 7 GROUP BY 1, 2", "spans")(_hotspots)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Each event as a begin and an end on its user's thread."""
    e = V._sql(s, d, V._EVENTS, [], events=_events(s, d))
    rows = [(0, "begin", F.col("event_type")), (1, "begin", F.lit("i")), (2, "end", F.lit("i")), (3, "end", F.col("event_type"))]
    each = F.explode(F.array(*[F.struct((F.col("event_id") * 4 + i).alias("seq"), F.lit(k).alias("kind"), n.alias("name")) for i, k, n in rows])).alias("m")
    marks = e.select(F.lit(0).cast("bigint").alias("pid"), F.col("user_id").alias("tid"), each).select("pid", "tid", "m.seq", F.col("m.seq").alias("timestamp_ns"), "m.kind", "m.name")
    return _run(s, pairing.pair_stream(marks))


query("stream_pairs", "SELECT 0::bigint AS pid, user_id AS tid, event_type AS name, event_id * 4 AS start_ns, 3::bigint AS duration_ns, 1 AS depth FROM ev UNION ALL SELECT 0, user_id, 'i', event_id * 4 + 1, 1, 2 FROM ev", "ev")(_pairs)
