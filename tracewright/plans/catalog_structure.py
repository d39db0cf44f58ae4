"""Trees, stacks, joins and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cct, context, diff, flame, hierarchy, joins
from ..operators import spans as S
from . import views as V
from .catalog import _PARENT, query

query(
    "children_of",
    _PARENT + """, k AS (SELECT parent_span_id, name, duration_ns, seq FROM spans WHERE coalesce(parent_span_id, '') <> ''), t AS (SELECT parent_span_id, count(*) AS children, cast(sum(duration_ns) AS bigint) AS children_ns FROM k GROUP BY parent_span_id),
n AS (SELECT parent_span_id, string_agg(name, ',' ORDER BY first) AS child_names FROM (SELECT parent_span_id, name, min(seq) AS first FROM k GROUP BY parent_span_id, name QUALIFY row_number() OVER (PARTITION BY parent_span_id ORDER BY min(seq)) <= 5) GROUP BY parent_span_id)
SELECT t.parent_span_id, parent_name AS parent, parent_category AS category, parent_ns, children, children_ns, CASE WHEN parent_ns > 0 THEN cast(100 AS double) * children_ns / parent_ns ELSE 0 END AS pct_of_parent, child_names
FROM t JOIN ids ON t.parent_span_id = pid_ JOIN n ON n.parent_span_id = t.parent_span_id ORDER BY children_ns DESC, t.parent_span_id LIMIT 10""",
    "spans",
)(lambda s, d: hierarchy.children_of(V.spans(s, d)).withColumn("child_names", F.array_join("child_names", ",")))
query(
    "cross_thread_children",
    _PARENT + " SELECT seq, name, pid, tid, parent_name AS parent, ppid, ptid, duration_ns FROM spans JOIN ids ON parent_span_id = pid_ WHERE pid <> ppid OR tid <> ptid",
    "spans",
)(lambda s, d: hierarchy.cross_thread_children(V.spans(s, d)))
query(
    "link_depths",
    ", r AS (SELECT a.span_id, cast(0 AS bigint) AS depth FROM spans a LEFT JOIN spans b ON a.parent_span_id = b.span_id WHERE b.span_id IS NULL UNION ALL SELECT c.span_id, r.depth + 1 FROM spans c JOIN r ON c.parent_span_id = r.span_id) SELECT span_id, depth FROM r",
    "spans",
)(lambda s, d: hierarchy.depths(V.spans(s, d)))
# Open spans of each thread, row by row: those that ended go from the top; the top holds the span if it ends no sooner.
_NEST = """, x AS (SELECT *, row_number() OVER (PARTITION BY pid, tid ORDER BY start_ns, seq) AS n FROM spans WHERE duration_ns > 0),
st AS (
  SELECT x.pid, x.tid, x.n, x.seq, cast(NULL AS bigint) AS held, [{'s': x.seq, 'e': x.end_ns}] AS open FROM x WHERE n = 1
  UNION ALL
  SELECT pid, tid, n, seq, CASE WHEN len(left_) > 0 AND left_[len(left_)].e >= end_ns THEN left_[len(left_)].s END, list_append(left_, {'s': seq, 'e': end_ns})
  FROM (SELECT x.*, st.open[1:coalesce(list_max(list_transform(generate_series(1, len(st.open)), lambda i: CASE WHEN st.open[i].e > x.start_ns THEN i ELSE 0 END)), 0)] AS left_ FROM st JOIN x ON x.pid = st.pid AND x.tid = st.tid AND x.n = st.n + 1)),
own AS (SELECT pid, tid, span_id, arg_max(seq, (start_ns, seq)) AS said FROM x WHERE coalesce(span_id, '') <> '' GROUP BY ALL),
par AS (SELECT x.pid, x.tid, x.seq, x.name, x.category, x.duration_ns, coalesce(nullif(own.said, x.seq), st.held) AS parent_seq FROM x JOIN st ON st.seq = x.seq LEFT JOIN own ON own.pid = x.pid AND own.tid = x.tid AND own.span_id = x.parent_span_id),
way AS (
  SELECT pid, tid, seq, duration_ns, [name || chr(31) || category] AS path FROM par WHERE parent_seq IS NULL
  UNION ALL SELECT par.pid, par.tid, par.seq, par.duration_ns, list_append(way.path, par.name || chr(31) || par.category) FROM par JOIN way ON par.parent_seq = way.seq),
node AS (SELECT pid, tid, path, cast(sum(duration_ns) AS bigint) AS total_ns, count(*) AS count FROM way GROUP BY ALL),
below AS (SELECT pid, tid, path[1:len(path) - 1] AS path, cast(sum(total_ns) AS bigint) AS below_ns FROM node WHERE len(path) > 1 GROUP BY ALL),
tree AS (SELECT node.*, greatest(0, total_ns - coalesce(below_ns, 0)) AS self_ns FROM node LEFT JOIN below ON below.pid = node.pid AND below.tid = node.tid AND below.path = node.path)
"""
_joined = lambda df: df.withColumn("path", F.array_join("path", ";"))
query("containment", _NEST + "SELECT par.pid, par.tid, par.seq, parent_seq, array_to_string(path, ';') AS path FROM par JOIN way USING (seq)", "spans")(lambda s, d: _joined(hierarchy.containment(V.spans(s, d)).select("pid", "tid", "seq", "parent_seq", "path")))
query(
    "containment_tree",
    _NEST + "SELECT pid, tid, array_to_string(path, ';') AS path, cast(len(path) - 1 AS integer) AS depth, split_part(path[len(path)], chr(31), 1) AS name, split_part(path[len(path)], chr(31), 2) AS category, total_ns, count, self_ns FROM tree",
    "spans",
)(lambda s, d: _joined(hierarchy.call_tree(V.spans(s, d))))
query(
    "trace_tree",
    _NEST + """, r AS (SELECT *, 'Thread ' || cast(tid AS varchar) || ' (pid ' || cast(pid AS varchar) || ')' AS root FROM tree)
SELECT root AS path, 0 AS depth, 'other' AS category, cast(sum(total_ns) AS bigint) AS total_ns, cast(sum(count) AS bigint) AS count FROM r WHERE len(path) = 1 GROUP BY root
UNION ALL SELECT root || ';' || array_to_string(path, ';'), cast(len(path) AS integer), split_part(path[len(path)], chr(31), 2), total_ns, count FROM r""",
    "spans",
)(lambda s, d: _joined(hierarchy.trace_tree(V.spans(s, d))))
query(
    "parent_child_orders",
    ", p AS (SELECT id, name, category FROM nested WHERE kind = 'parent') SELECT p.name AS parent_name, c.name, count(*) AS count, cast(sum(c.duration_ns) AS bigint) AS total_ns FROM nested c JOIN p ON c.parent = p.id GROUP BY p.name, c.name",
    "nested",
)(
    lambda s, d: (lambda n: n.where("kind = 'child'").alias("c").join(n.where("kind = 'parent'").select(F.col("id").alias("pid_"), F.col("name").alias("parent_name")), F.col("c.parent") == F.col("pid_")))(V.nested(s, d))
    .groupBy("parent_name", "name")
    .agg(F.count("*").alias("count"), F.sum("duration_ns").alias("total_ns"))
)


# ------------------------------------------------------------------ stacks


def _stacked(s, d):  # noqa: ANN001, ANN202
    """Customers as spans with call stacks (innermost first), weighted by balance."""
    c, n, r = V.load(s, d, "customer"), V.load(s, d, "nation"), V.load(s, d, "region")
    both = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return both.select(
        F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "cuda").otherwise("openmp").alias("category"), F.lit(0).cast("bigint").alias("pid"), F.lit(0).cast("bigint").alias("tid"),
        F.col("c_custkey").alias("start_ns"), (F.floor(F.abs("c_acctbal")).cast("bigint") + 1).alias("duration_ns"), F.array("n_name", "r_name", F.lit("main")).alias("stack_frames"), F.create_map().cast("map<string,string>").alias("tags"),
    )


_STACKED = """WITH c AS (SELECT c_custkey AS seq, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN 'cuda' ELSE 'openmp' END AS category, cast(floor(abs(c_acctbal)) AS bigint) + 1 AS duration_ns, ['main', r_name, n_name] AS frames FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT list_append(frames, name) AS path, category, duration_ns FROM c),
x AS (SELECT path[1:i] AS path, i = len(path) AS leaf, category, duration_ns FROM (SELECT *, unnest(generate_series(1, len(path))) AS i FROM p)),
nodes AS (SELECT array_to_string(path, ';') AS path, path[len(path)] AS frame, len(path) AS depth, count(*) FILTER (leaf) AS self_count, cast(coalesce(sum(duration_ns) FILTER (leaf), 0) AS bigint) AS self_ns, min(duration_ns) FILTER (leaf) AS self_min_ns, max(duration_ns) FILTER (leaf) AS self_max_ns,
  coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (leaf), '') AS categories, cast(sum(duration_ns) AS bigint) AS incl_ns, count(*) AS incl_count FROM x GROUP BY path)
"""
_text = lambda df: df.withColumn("path", F.array_join("path", ";")).withColumn("categories", F.array_join("categories", ","))
_nodes = lambda s, d: cct.build(cct.paths(_stacked(s, d)))
query("cct", _STACKED + "SELECT path, frame, cast(depth AS integer) AS depth, self_count, self_ns, self_min_ns, self_max_ns, categories, incl_ns, incl_count FROM nodes")(lambda s, d: _text(_nodes(s, d)))
query("cct_top_self", _STACKED + "SELECT path, self_count, self_ns, self_ns / self_count AS self_avg_ns FROM nodes WHERE self_count > 0 AND contains(categories, 'cuda') ORDER BY self_ns DESC, path LIMIT 15")(
    lambda s, d: _text(cct.top_self(_nodes(s, d), 15, "cuda")).select("path", "self_count", "self_ns", "self_avg_ns")
)
query("cct_top_inclusive", _STACKED + "SELECT path, incl_ns, incl_count FROM nodes ORDER BY incl_ns DESC, path LIMIT 15")(lambda s, d: _text(cct.top_inclusive(_nodes(s, d))).select("path", "incl_ns", "incl_count"))
query("cct_total", _STACKED + "SELECT cast(sum(self_ns) AS bigint) AS total_ns FROM nodes")(lambda s, d: cct.total_exclusive(_nodes(s, d)))
query("cct_root", _STACKED + "SELECT cast(sum(incl_ns) AS bigint) AS incl_ns, cast(sum(incl_count) AS bigint) AS incl_count FROM nodes WHERE depth = 1")(lambda s, d: cct.root(_nodes(s, d)))
query("cct_display", _STACKED + ", q AS (SELECT string_split(path, ';') AS p FROM nodes) SELECT left(CASE WHEN len(p) > 3 THEN '…/' || left(p[len(p) - 1], 20) || '/' || left(p[len(p)], 20) ELSE array_to_string(list_transform(p, lambda x: left(x, 22)), '/') END, 42) AS display FROM q")(
    lambda s, d: _nodes(s, d).select(cct.display_path().alias("display"))
)
query(
    "stack_tree",
    """WITH c AS (SELECT c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN 'cuda' ELSE 'openmp' END AS category, cast(floor(abs(c_acctbal)) AS bigint) + 1 AS duration_ns, ['main', r_name, n_name] AS frames FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT frames[1:i] AS path, CASE WHEN i = 3 THEN category ELSE 'other' END AS category, duration_ns, CASE WHEN i = 3 THEN 1 ELSE 0 END AS n FROM (SELECT *, unnest(generate_series(1, 3)) AS i FROM c) UNION ALL SELECT list_append(frames, '__leaf__' || name), category, duration_ns, 1 FROM c)
SELECT array_to_string(path, ';') AS path, max(category) AS category, cast(sum(duration_ns) AS bigint) AS total_ns, cast(sum(n) AS bigint) AS count, cast(len(path) - 1 AS integer) AS depth FROM x GROUP BY path""",
)(lambda s, d: hierarchy.stack_tree(_stacked(s, d)).withColumn("path", F.array_join("path", ";")))
query("folded_stacks", "SELECT concat('main;', r_name, ';', n_name) AS stack, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")(lambda s, d: flame.fold(_stacked(s, d)))

_FLAME = ", f AS (SELECT string_split(stack, ';') AS p, count FROM folded), t AS (SELECT p[1:i] AS path, len(p) = i AS leaf, count FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM f)), n AS (SELECT path, path[len(path)] AS name, len(path) AS depth, cast(sum(count) AS bigint) AS value, cast(coalesce(sum(count) FILTER (leaf), 0) AS bigint) AS self FROM t GROUP BY path)"
_path = lambda df: df.withColumn("path", F.array_join("path", ";"))
query("flame_tree", _FLAME + " SELECT array_to_string(path, ';') AS path, name, cast(depth AS integer) AS depth, value, self FROM n", "folded")(lambda s, d: _path(flame.tree(V.folded(s, d))))
query("folded_total", "SELECT cast(sum(count) AS bigint) AS total FROM folded", "folded")(lambda s, d: flame.total(V.folded(s, d)))
query("flame_children", _FLAME + " SELECT array_to_string(path, ';') AS path, value, cast(row_number() OVER (PARTITION BY path[1:len(path) - 1] ORDER BY value DESC, name) AS integer) AS rank FROM n", "folded")(
    lambda s, d: _path(flame.children(flame.tree(V.folded(s, d)))).select("path", "value", "rank")
)
_LAYOUT = _FLAME + ", o AS (SELECT *, coalesce(cast(sum(value) OVER (PARTITION BY path[1:len(path) - 1] ORDER BY value DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS off FROM n), a AS (SELECT cast(sum(value) AS double) AS whole FROM n WHERE depth = 1)"
query("flame_layout", _LAYOUT + " SELECT array_to_string(x.path, ';') AS path, x.name, cast(x.depth AS integer) AS depth, x.value, x.self, cast(sum(y.off) AS bigint) / max(whole) AS x, x.value / max(whole) AS width FROM o x JOIN o y ON x.path[1:len(y.path)] = y.path, a GROUP BY x.path, x.name, x.depth, x.value, x.self", "folded")(
    lambda s, d: _path(flame.layout(flame.tree(V.folded(s, d))))
)
query(
    "flame_icicle",
    _FLAME + ", r AS (SELECT *, row_number() OVER (PARTITION BY path[1:len(path) - 1] ORDER BY value DESC, name) AS rank FROM n), a AS (SELECT sum(value) AS whole FROM n WHERE depth = 1) SELECT array_to_string(x.path, ';') AS path, string_agg(cast(y.rank AS varchar), '.' ORDER BY y.depth) AS ord, contains(lower(x.name), 'a') AS hit FROM r x JOIN r y ON x.path[1:len(y.path)] = y.path, a WHERE cast(100 AS double) * x.value / whole >= 0.02 GROUP BY x.path, x.name",
    "folded",
)(lambda s, d: _path(flame.icicle(flame.tree(V.folded(s, d)), search="A")).select("path", F.array_join(F.transform("order", lambda x: x.cast("string")), ".").alias("ord"), "hit"))
query("flame_zoom", _FLAME + " SELECT count(*) AS n, cast(sum(self) AS bigint) AS self FROM n WHERE path[1] = 'EUROPE'", "folded")(
    lambda s, d: flame.zoom(flame.tree(V.folded(s, d)), ["EUROPE"]).agg(F.count("*").alias("n"), F.sum("self").alias("self"))
)
query("flame_search", _FLAME + " SELECT array_to_string(path, ';') AS path, value FROM n WHERE regexp_matches(name, '^B.*Y$|MACH')", "folded")(lambda s, d: _path(flame.search(flame.tree(V.folded(s, d)), "^B.*Y$|MACH", True)).select("path", "value"))

# ------------------------------------------------------------------ joins

query(
    "nearest_symbol",
    "WITH a AS (SELECT o_orderkey * 7 AS addr FROM orders), s AS (SELECT DISTINCT p_partkey * 53 AS addr, p_name AS name FROM part) SELECT a.addr, s.name AS symbol, a.addr - s.addr AS offset FROM a ASOF LEFT JOIN s ON a.addr >= s.addr",
)(lambda s, d: joins.nearest_symbol(V.load(s, d, "orders").select((F.col("o_orderkey") * 7).alias("addr")), V.load(s, d, "part").select((F.col("p_partkey") * 53).alias("addr"), F.col("p_name").alias("name"))))
query(
    "kernel_binding",
    """, k AS (SELECT * FROM (VALUES ('kernel_1', 0), ('ns::copy_2', 1), ('loop', 2)) t(kernel, pos)), n AS (SELECT DISTINCT name FROM spans),
e AS (SELECT n.name, coalesce(k.kernel, a.kernel) AS kernel FROM n LEFT JOIN k ON k.kernel = n.name LEFT JOIN (SELECT kernel, regexp_extract(kernel, '([^:]*)$', 1) AS alias FROM k) a ON a.alias = n.name)
SELECT name, kernel FROM e WHERE kernel IS NOT NULL UNION ALL SELECT e.name, arg_min(k.kernel, pos) FROM e JOIN k ON contains(e.name, k.kernel) OR contains(k.kernel, e.name) WHERE e.kernel IS NULL GROUP BY e.name""",
    "spans",
)(lambda s, d: joins.kernel_binding(V.spans(s, d), s.sql("SELECT * FROM VALUES ('kernel_1', 0), ('ns::copy_2', 1), ('loop', 2) AS t(kernel, pos)")))
query(
    "device_of",
    ", c AS (SELECT DISTINCT category FROM spans) SELECT category, cast(CASE WHEN category = 'cuda' THEN 0 WHEN category IN ('openmp', 'cpu', 'opencl') THEN 1 ELSE 0 END AS integer) AS device_idx FROM c",
    "spans",
)(lambda s, d: joins.device_of(V.spans(s, d).select("category").distinct(), V.devices(s)))
query(
    "kernel_list",
    ", k AS (SELECT * FROM (VALUES ('kernel_1'), ('absent')) t(name)) SELECT k.name, coalesce(cast(sum(duration_ns) AS bigint), 0) AS total_ns, count(seq) > 0 AS profiled FROM k LEFT JOIN spans ON spans.name = k.name GROUP BY k.name",
    "spans",
)(lambda s, d: joins.kernel_list(V.spans(s, d), s.sql("SELECT * FROM VALUES ('kernel_1'), ('absent') AS t(kernel)")))
query(
    "pc_heat",
    """WITH p AS (SELECT l_returnflag AS func_name, l_partkey % 50 AS pc_offset, cast(l_linenumber + 1 AS integer) AS stall_reason, cast(l_quantity AS bigint) AS count FROM lineitem), q AS (SELECT func_name, pc_offset, stall_reason, cast(sum(count) AS bigint) AS c FROM p GROUP BY ALL),
r AS (SELECT func_name, pc_offset, cast(sum(c) AS bigint) AS samples, arg_max(stall_reason, (c, -stall_reason)) AS stall FROM q GROUP BY ALL)
SELECT func_name, pc_offset, samples, cast(100 AS double) * samples / cast(sum(samples) OVER (PARTITION BY func_name) AS bigint) AS pct, CASE stall WHEN 1 THEN 'none' WHEN 2 THEN 'inst_fetch' WHEN 3 THEN 'exec_dep' WHEN 4 THEN 'mem_dep' WHEN 5 THEN 'texture' WHEN 6 THEN 'sync' WHEN 7 THEN 'const_mem' WHEN 8 THEN 'pipe_busy' ELSE '' END AS stall_reason FROM r""",
)(lambda s, d: joins.pc_heat(V.load(s, d, "lineitem").select(F.col("l_returnflag").alias("func_name"), (F.col("l_partkey") % 50).alias("pc_offset"), (F.col("l_linenumber") + 1).alias("stall_reason"), F.col("l_quantity").cast("bigint").alias("count"))))
query("frames", "WITH c AS (SELECT c_custkey AS seq, concat(c_name, '|', c_mktsegment, '|0x', c_nationkey) AS f FROM customer) SELECT seq, cast(0 AS integer) AS pos, split_part(f, '|', 1) AS symbol, split_part(f, '|', 2) AS library, split_part(f, '|', 3) AS offset FROM c")(
    lambda s, d: S.frames(V.load(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.array(F.concat("c_name", F.lit("|"), "c_mktsegment", F.lit("|0x"), F.col("c_nationkey").cast("string"))).alias("stack_frames")))
)

# ------------------------------------------------------------------ two traces

_CUT = 1705276800000000000
_AB = f", a AS (SELECT * FROM spans WHERE start_ns < {_CUT}), b AS (SELECT * FROM spans WHERE start_ns >= {_CUT})"
_ab = lambda s, d: (lambda x: (x.where(F.col("start_ns") < _CUT), x.where(F.col("start_ns") >= _CUT)))(V.spans(s, d))
query("diff_wall", _AB + ", w AS (SELECT (SELECT max(end_ns) - min(start_ns) FROM a) AS before_ns, (SELECT max(end_ns) - min(start_ns) FROM b) AS after_ns) SELECT before_ns, after_ns, after_ns - before_ns AS delta_ns, cast(100 AS double) * (after_ns - before_ns) / before_ns AS pct FROM w", "spans")(lambda s, d: diff.wall_change(*_ab(s, d)))
query(
    "diff_categories",
    _AB + ", x AS (SELECT category, cast(sum(duration_ns) AS bigint) AS t FROM a GROUP BY 1), y AS (SELECT category, cast(sum(duration_ns) AS bigint) AS t FROM b GROUP BY 1) SELECT category, coalesce(x.t, 0) AS before_ns, coalesce(y.t, 0) AS after_ns, coalesce(y.t, 0) - coalesce(x.t, 0) AS delta_ns FROM x FULL JOIN y USING (category)",
    "spans",
)(lambda s, d: diff.category_changes(*_ab(s, d)))
query(
    "diff_full",
    _AB + ", x AS (SELECT category, name, cast(sum(duration_ns) AS bigint) AS t FROM a GROUP BY 1, 2), y AS (SELECT category, name, cast(sum(duration_ns) AS bigint) AS t FROM b GROUP BY 1, 2) SELECT category, name, coalesce(x.t, 0) AS before_ns, coalesce(y.t, 0) AS after_ns, coalesce(y.t, 0) - coalesce(x.t, 0) AS delta_ns FROM x FULL JOIN y USING (category, name)",
    "spans",
)(lambda s, d: diff.full(*_ab(s, d)))
query(
    "diff_hotspots",
    _AB + """, x AS (SELECT name, category, cast(sum(duration_ns) AS bigint) AS t FROM a GROUP BY 1, 2 ORDER BY t DESC, category, name LIMIT 15), y AS (SELECT name, category, cast(sum(duration_ns) AS bigint) AS t FROM b GROUP BY 1, 2 ORDER BY t DESC, category, name LIMIT 15),
f AS (SELECT name, t FROM x ORDER BY t DESC, category, name LIMIT 8) SELECT f.name, f.t AS before_ns, y.t AS after_ns, y.t - f.t AS delta_ns FROM f JOIN y ON f.name = y.name WHERE abs(y.t - f.t) > 100000""",
    "spans",
)(lambda s, d: diff.hotspot_changes(*_ab(s, d)))
query("hardware", "SELECT backend || '_device' AS key, name, fp32_tflops, fp64_tflops, bandwidth_gbs AS peak_mem_bw_gbs, fp16_tflops, cast(sm_count AS integer) AS sm_count FROM (SELECT cast(fp32_tflops AS double) AS fp32_tflops, cast(fp64_tflops AS double) AS fp64_tflops, cast(bandwidth_gbs AS double) AS bandwidth_gbs, cast(fp16_tflops AS double) AS fp16_tflops, backend, name, sm_count FROM devices)", "devices")(
    lambda s, d: context.hardware(V.devices(s))
)
