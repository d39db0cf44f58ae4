"""Records written from the tables and read back, pairings, and the remaining look-ups and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as X
from ..functions import names as N
from ..operators import hotspots, joins, roofline
from ..sources import perf, tools, wire
from ..streaming import pairing
from . import views as V
from .catalog import query


def _lines(s, d):  # noqa: ANN001, ANN202
    """The events as hook records: every fiftieth broken, every third with a stack, so that both kinds are there."""
    e = V.spans(s, d)
    text = F.concat_ws(":", F.lit("span"), "category", F.when(F.col("seq") % 50 == 7, "x").otherwise(F.col("pid").cast("string")), F.col("tid").cast("string"), F.col("start_ns").cast("string"), F.col("duration_ns").cast("string"), "name", F.concat(F.lit("type="), F.coalesce(F.element_at("tags", "type"), F.lit("none")), F.lit(",sid="), "span_id", F.lit(",flag")))
    spans = e.select((F.col("seq") * 2).alias("seq"), text.alias("value"))
    stk = e.where("seq % 3 = 0").select((F.col("seq") * 2 + 1).alias("seq"), F.concat(F.lit("stk:"), F.col("pid").cast("string"), F.lit(":"), F.col("tid").cast("string"), F.lit(":"), F.col("start_ns").cast("string"), F.lit(":f::g;main")).alias("value"))
    ctr = V.counters(s, d).select((F.col("seq") * 2 + 1_000_000_000).alias("seq"), F.concat(F.lit("ctr:memory:1:"), F.col("timestamp_ns").cast("string"), F.lit(":"), "name", F.lit(":"), F.col("value").cast("string"), F.lit(":u")).alias("value"))
    return spans.unionByName(stk).unionByName(ctr)


query(
    "wire_spans",
    "SELECT seq * 2 AS seq, name, category, start_ns, duration_ns, end_ns, pid, tid, coalesce(t_type, 'none') AS type, span_id FROM spans WHERE seq % 50 <> 7",
    "spans",
)(lambda s, d: wire.spans(wire.parse(_lines(s, d))).select("seq", "name", "category", "start_ns", "duration_ns", "end_ns", "pid", "tid", F.element_at("tags", "type").alias("type"), "span_id"))
query("wire_counters", "SELECT seq * 2 + 1000000000 AS seq, name, timestamp_ns, value, 'u' AS unit FROM counters", "counters")(lambda s, d: wire.counters(wire.parse(_lines(s, d))).select("seq", "name", "timestamp_ns", "value", "unit"))
query("wire_quarantine", "SELECT seq * 2 AS seq FROM spans WHERE seq % 50 = 7", "spans")(lambda s, d: wire.quarantine(wire.parse(_lines(s, d))).select("seq"))
query(
    "wire_stacks",
    ", p AS (SELECT seq * 2 AS seq, pid, tid, start_ns FROM spans WHERE seq % 50 <> 7), k AS (SELECT seq * 2 + 1 AS seq, pid, tid, start_ns FROM spans WHERE seq % 3 = 0) SELECT p.seq, 'f::g;main' AS stack FROM p WHERE EXISTS (SELECT 1 FROM k WHERE k.pid = p.pid AND k.tid = p.tid AND k.start_ns = p.start_ns AND k.seq > p.seq)",
    "spans",
)(lambda s, d: (lambda p: wire.attach(wire.spans(p), wire.stacks(p)).where("size(stack_frames) > 0").select("seq", F.array_join("stack_frames", ";").alias("stack")))(wire.parse(_lines(s, d))))
query("sample_counts", "SELECT concat('f', cast(k % 15 AS varchar)) AS name, count(*) AS samples FROM ev GROUP BY 1 ORDER BY samples DESC, name LIMIT 10", "ev")(
    lambda s, d: hotspots.sample_counts(V.events(s, d).select(F.concat(F.lit("f"), (F.col("k") % 15).cast("string")).alias("name"), F.lit("cpu").alias("category"), F.lit(0).cast("bigint").alias("duration_ns")))
)
query("approximate_percentiles")(lambda s, d: hotspots.approximate_percentiles(V.spans(s, d)))
query(
    "heat_of_instructions",
    """, h AS (SELECT p_brand AS kernel, l_linenumber AS addr, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), x AS (SELECT kernel, addr, cast(100 AS double) * c / cast(sum(c) OVER (PARTITION BY kernel) AS bigint) AS sample_pct FROM h)
SELECT i.kernel, i.pos, sample_pct FROM insns i LEFT JOIN x ON x.kernel = i.kernel AND x.addr = i.pos % 8""",
    "insns",
)(
    lambda s, d: joins.annotate_heat(
        V.instructions(s, d).withColumn("addr", F.col("pos") % 8),
        V.load(s, d, "lineitem").join(V.load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("func_name"), F.col("l_linenumber").cast("bigint").alias("pc_offset"), F.lit(4).alias("stall_reason"), F.col("l_quantity").cast("bigint").alias("count")),
    ).select("kernel", "pos", "sample_pct")
)
query("source_lines", ", t AS (SELECT p_partkey % 8 AS addr, min(p_name) AS file, cast(max(p_size) AS integer) AS line FROM part GROUP BY 1) SELECT kernel, pos, file AS source_file, line AS source_line FROM insns LEFT JOIN t ON addr = pos % 8", "insns")(
    lambda s, d: joins.source_lines(V.instructions(s, d).withColumn("addr", F.col("pos") % 8), V.load(s, d, "part").groupBy((F.col("p_partkey") % 8).alias("addr")).agg(F.min("p_name").alias("file"), F.max("p_size").alias("line"))).select("kernel", "pos", "source_file", "source_line")
)
query("first_location", "SELECT name, arg_min(concat('f', cast(k AS varchar), '.c:', cast(seq % 9 AS varchar)), seq) AS location FROM (SELECT s.*, ev.k FROM spans s JOIN ev ON seq = event_id WHERE ev.k % 2 = 0) GROUP BY name", "spans")(
    lambda s, d: joins.first_location(V.spans(s, d).join(V.events(s, d).select(F.col("event_id").alias("seq"), "k"), "seq").select("seq", "name", F.when(F.col("k") % 2 == 0, F.create_map(F.lit("file"), F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".c")), F.lit("line"), (F.col("seq") % 9).cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("tags")))
)

# ------------------------------------------------------------------ pairings

query(
    "allocation_balance",
    """, o AS (SELECT event_id AS seq, CASE WHEN k % 3 < 2 THEN 'alloc' ELSE 'free' END AS kind, user_id AS ptr, k * 16 AS bytes FROM ev), b AS (SELECT *, lag(kind) OVER w AS pk, lag(bytes) OVER w AS pb FROM o WINDOW w AS (PARTITION BY ptr ORDER BY seq)),
x AS (SELECT seq, CASE WHEN kind = 'alloc' THEN bytes WHEN pk = 'alloc' THEN -pb ELSE 0 END AS delta FROM b) SELECT seq, delta, cast(sum(delta) OVER (ORDER BY seq) AS bigint) AS live_bytes FROM x""",
    "ev",
)(lambda s, d: pairing.allocation_balance(_ops(s, d)).select("seq", "delta", "live_bytes"))
query("allocation_leaks", ", o AS (SELECT event_id AS seq, CASE WHEN k % 3 < 2 THEN 'alloc' ELSE 'free' END AS kind, user_id AS ptr, k * 16 AS bytes FROM ev) SELECT ptr, arg_max(bytes, seq) AS bytes FROM o GROUP BY ptr HAVING arg_max(kind, seq) = 'alloc'", "ev")(lambda s, d: pairing.leaks(_ops(s, d)))
query("device_clocks", ", o AS (SELECT event_type AS device, event_id AS seq, us AS device_ns, us * 2 + k AS host_ns FROM ev), f AS (SELECT device, arg_min(host_ns - device_ns, seq) AS off FROM o GROUP BY device) SELECT seq, device_ns + off AS time_ns FROM o JOIN f USING (device)", "ev")(
    lambda s, d: pairing.calibrated(V.events(s, d).select(F.col("event_type").alias("device"), F.col("event_id").alias("seq"), F.col("us").alias("device_ns"), (F.col("us") * 2 + F.col("k")).alias("host_ns"))).select("seq", "time_ns")
)
query(
    "begin_end_pairs",
    ", b AS (SELECT o_orderkey, o_custkey FROM orders) SELECT o_custkey AS tid, cast(o_orderkey AS varchar) AS name, o_orderkey * 4 AS start_ns, 3::bigint AS duration_ns, 1 AS depth FROM b UNION ALL SELECT o_custkey, 'i', o_orderkey * 4 + 1, 1, 2 FROM b".lstrip(", ").replace("b AS", "WITH b AS", 1),
)(lambda s, d: pairing.pair(_marks(s, d)).select("tid", "name", "start_ns", "duration_ns", "depth"))
query("request_waits", "SELECT o_orderkey AS req_id, o_orderpriority AS name, o_orderkey AS start_ns, 'MPI_Wait' AS waited_by, 5::bigint AS latency_ns FROM orders WHERE o_orderkey % 2 = 0")(
    lambda s, d: (lambda o: pairing.requests(o.select(F.col("o_orderkey").alias("req_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("start_ns"), F.col("t").alias("event_time")), o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("req_id"), F.lit("MPI_Wait").alias("name"), (F.col("o_orderkey") + 5).alias("start_ns"), F.col("t").alias("event_time"))))(
        V.load(s, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    )
)


def _ops(s, d):  # noqa: ANN001, ANN202
    kind = F.when(F.col("k") % 3 < 2, "alloc").otherwise("free")
    return V.events(s, d).select(F.col("event_id").alias("seq"), F.col("us").alias("timestamp_ns"), kind.alias("kind"), F.col("user_id").alias("ptr"), (F.col("k") * 16).alias("bytes"))


def _marks(s, d):  # noqa: ANN001, ANN202
    """Each order as a span with another one inside, on its customer's thread."""
    o = V.load(s, d, "orders").select("o_orderkey", "o_custkey")
    rows = [(0, "begin", F.col("o_orderkey").cast("string")), (1, "begin", F.lit("i")), (2, "end", F.lit("i")), (3, "end", F.col("o_orderkey").cast("string"))]
    each = F.explode(F.array(*[F.struct((F.col("o_orderkey") * 4 + i).alias("seq"), F.lit(k).alias("kind"), n.alias("name")) for i, k, n in rows])).alias("m")
    return o.select(F.lit(0).cast("bigint").alias("pid"), F.col("o_custkey").alias("tid"), each).select("pid", "tid", "m.seq", F.col("m.seq").alias("timestamp_ns"), "m.kind", "m.name")


# ------------------------------------------------------------------ machines and formats

query(
    "best_source",
    "SELECT CASE c_nationkey % 4 WHEN 0 THEN 'perf_llcproxy' WHEN 1 THEN 'perf_amd' WHEN 2 THEN 'other' ELSE 'perf_uncore' END AS source, cast(count(*) AS bigint) AS n FROM customer GROUP BY c_nationkey ORDER BY CASE source WHEN 'perf_uncore' THEN 1 WHEN 'perf_amd' THEN 3 WHEN 'perf_llcproxy' THEN 4 ELSE 9 END, n LIMIT 1",
)(
    lambda s, d: roofline.best_source(
        V.load(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
        .select(F.when(F.col("c_nationkey") % 4 == 0, "perf_llcproxy").when(F.col("c_nationkey") % 4 == 1, "perf_amd").when(F.col("c_nationkey") % 4 == 2, "other").otherwise("perf_uncore").alias("source"), "n")
    )
)
query(
    "likwid_rates",
    "WITH m AS (SELECT l_orderkey AS f, l_linenumber AS core, l_quantity AS value FROM lineitem) SELECT 'likwid.total.flops' AS name, f, sum(value) AS value FROM m GROUP BY f HAVING count(*) > 1",
)(
    lambda s, d: tools.likwid_counters(V.load(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit(0).alias("pos"), F.lit("Flops").alias("name"), F.lit("MFLOP/s").alias("unit"), F.col("l_linenumber").alias("core"), F.col("l_quantity").alias("value")))
    .where("name like 'likwid.total%'")
    .select("name", F.col("file").alias("f"), "value")
)
query("gpu_polling", "SELECT concat('gpu_utilization_pct[gpu', cast(p_partkey % 4 AS varchar), ']') AS name, cast(p_size AS double) AS value FROM part UNION ALL SELECT concat('gpu_mem_util_pct[gpu', cast(p_partkey % 4 AS varchar), ']'), 5 FROM part UNION ALL SELECT concat('gpu_mem_used_bytes[gpu', cast(p_partkey % 4 AS varchar), ']'), p_partkey * 1048576 FROM part")(
    lambda s, d: tools.nvidia_smi(V.load(s, d, "part").select(F.concat_ws(", ", (F.col("p_partkey") % 4).cast("string"), F.col("p_size").cast("string"), F.lit("5"), F.col("p_partkey").cast("string")).alias("value"))).select("name", "value")
)
query("processor_counters", "SELECT cast(c_nationkey AS varchar) AS file, 'ipc' AS name, cast(sum(c_custkey) AS double) / 1000000 AS value FROM customer WHERE c_custkey > 0 GROUP BY c_nationkey HAVING sum(c_custkey) > 0")(
    lambda s, d: perf.microarch(
        V.load(s, d, "customer").where("c_custkey > 0").groupBy("c_nationkey").agg(F.sum("c_custkey").alias("n")).select(F.col("c_nationkey").cast("string").alias("file"), F.concat(F.lit("  1,000,000      cpu/cycles/\n  "), F.format_number("n", 0), F.lit("      instructions:u\n")).alias("value"))
    )
)
query("format_bytes", "SELECT o_orderkey, CASE WHEN v >= 1073741824 THEN printf('%.2f GB', v / 1073741824) WHEN v >= 1048576 THEN printf('%.1f MB', v / 1048576) WHEN v >= 1024 THEN printf('%.0f KB', v / 1024) ELSE printf('%.0f B', v) END AS text FROM (SELECT o_orderkey, cast(o_orderkey * 1048576 + 12345 AS double) AS v FROM orders)")(
    lambda s, d: V.load(s, d, "orders").select("o_orderkey", X.fmt_bytes(F.col("o_orderkey") * 1048576 + 12345).alias("text"))
)
query("event_names", "SELECT p_partkey, lower(p_name) AS event FROM part")(lambda s, d: V.load(s, d, "part").select("p_partkey", X.perf_event(F.concat(F.lit("cpu-x/"), F.upper("p_name"), F.lit("/"))).alias("event")))
query("symbols", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS symbol FROM part")(lambda s, d: V.load(s, d, "part").select("p_partkey", X.symbol(F.when(F.col("p_size") % 3 == 0, "[unknown]").otherwise(F.concat("p_name", F.lit("+0x1f")))).alias("symbol")))
query("backend_names", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'openmp' WHEN 1 THEN 'rocm' ELSE 'cuda' END AS backend, CASE p_size % 2 WHEN 0 THEN 8 ELSE 0 END AS bytes FROM part")(
    lambda s, d: V.load(s, d, "part").select("p_partkey", N.backend(F.when(F.col("p_size") % 3 == 0, "omp").when(F.col("p_size") % 3 == 1, "hip").otherwise("cuda")).alias("backend"), N.mpi_size(F.when(F.col("p_size") % 2 == 0, "MPI_DOUBLE").otherwise("?")).alias("bytes"))
)
query("jit_names", "SELECT p_partkey, '[jit:' || right(cast(1000000 + p_partkey AS varchar), 6) || '…' || right(cast(70000 + p_size AS varchar), 4) || ']' AS name FROM part")(
    lambda s, d: V.load(s, d, "part").select("p_partkey", N.jit_name(F.concat((1000000 + F.col("p_partkey")).cast("string"), F.lit("."), (70000 + F.col("p_size")).cast("string"), F.lit(".jit.so"))).alias("name"))
)
query("frame_sources", "SELECT c_custkey, c_name || ' (a.c:' || cast(c_nationkey AS varchar) || ')|/lib|0x1' AS frame FROM customer")(
    lambda s, d: V.load(s, d, "customer").select("c_custkey", N.frame_with_source(F.concat("c_name", F.lit("|/lib|0x1")), F.lit("/x/a.c"), F.col("c_nationkey")).alias("frame"))
)
