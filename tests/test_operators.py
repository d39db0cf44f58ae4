"""Operators against slow models, and their properties."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import names as N
from tracewright.functions.classify import classify
from tracewright.operators import cct, flame, hierarchy, insns, intervals, joins, roofline
from tracewright.plans import tools, views

SPAN = "seq long, name string, category string, start_ns long, duration_ns long, end_ns long, pid long, tid long, tags map<string,string>, stack_frames array<string>, span_id string, parent_span_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, n, "cpu", s, d, s + d, 0, t, {}, [], sid, psid) for i, (n, t, s, d, sid, psid) in enumerate(rows)], SPAN)


def model_parents(rows):
    """Which row each row lies in, by the plain loop."""
    out = {}
    for tid in {r[1] for r in rows}:
        mine = sorted((i for i, r in enumerate(rows) if r[1] == tid and r[3] > 0), key=lambda i: (rows[i][2], i))
        own = {rows[i][4]: i for i in mine if rows[i][4]}
        stack = []
        for i in mine:
            start, end = rows[i][2], rows[i][2] + rows[i][3]
            while stack and stack[-1][1] <= start:
                stack.pop()
            link = own.get(rows[i][5]) if rows[i][5] else None
            out[i] = link if link is not None and link != i else stack[-1][0] if stack and stack[-1][1] >= end else None
            stack.append((i, end))
    return out


def test_containment(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(4)}", rng.randrange(3), rng.randrange(400), rng.randrange(60), None, None) for _ in range(300)]
    rows += [("p", 9, 0, 50, "1", None), ("c", 9, 60, 10, None, "1"), ("d", 9, 61, 2, None, None)]
    got = {r.seq: r.parent_seq for r in hierarchy.containment(frame(spark, rows)).collect()}
    assert got == model_parents(rows)
    tree = hierarchy.call_tree(frame(spark, rows))
    assert tree.where("depth = 0").agg(F.sum("total_ns")).first()[0] <= sum(r[3] for r in rows)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 300), st.integers(0, 80)), max_size=40))
def test_union(spark, rows):
    covered = {t for s, d in rows for t in range(s, s + d)}
    df = spark.createDataFrame([(s, s + d) for s, d in rows], "start_ns long, end_ns long")
    assert intervals.union_length(df).first().union_ns == len(covered)


def test_tree_properties(spark, sf):
    from tracewright.plans.catalog_structure import _stacked

    spans = _stacked(spark, sf)
    nodes = cct.build(cct.paths(spans)).cache()
    total = spans.agg(F.sum("duration_ns")).first()[0]
    assert cct.total_exclusive(nodes).first().total_ns == total == cct.root(nodes).first().incl_ns


def test_samples_make_one_path(spark):
    tags = {"stack": "main;f;[cpu];g"}
    rows = [(i, n, "cpu", 5, 0, 5, 1, 1, tags, [], None, None) for i, n in enumerate(["main", "f", "g"])]
    nodes = cct.build(cct.paths(spark.createDataFrame(rows, SPAN)))
    assert {tuple(r.path): (r.self_count, r.incl_count) for r in nodes.collect()} == {("main",): (0, 1), ("main", "f"): (0, 1), ("main", "f", "g"): (1, 1)}


def test_bucket_overlap_adds_up(spark, sf):
    spans = views.spans(spark, sf)
    width, n = intervals.buckets(spans)
    got = intervals.bucket_overlap(spans, width, n, ["category"]).agg(F.sum("busy_ns")).first()[0]
    assert got == spans.agg(F.sum("duration_ns")).first()[0]


def test_flame_layout(spark):
    folded = spark.createDataFrame([("a;b", 3), ("a;c", 5), ("d", 2), ("a", 1), ("a;;b", 1)], "stack string, count long")
    nodes = flame.tree(folded)
    rows = {tuple(r.path): r for r in flame.layout(nodes).collect()}
    assert rows["a",].value == 10 and rows["a", "c"].x == 0.0 and rows["a", "b"].x == 5 / 12 and rows["d",].x == 10 / 12 and rows["a",].self == 1
    cols = {tuple(c["path"]): (c["x"], c["width"]) for c in flame.columns(nodes, 24)}
    assert cols["a",] == (0, 20) and cols["d",] == (20, 4) and cols["a", "c"] == (0, 10)
    assert flame.tree(folded, keep_blank=True).where("name = ''").count() == 1
    assert [r.name for r in flame.icicle(nodes, search="D").where("hit").collect()] == ["d"]
    assert {tuple(r.path) for r in flame.zoom(nodes, ["a"]).collect()} == {("a",), ("a", "b"), ("a", "c")}


def test_nearest_symbol(spark):
    syms = spark.createDataFrame([(10, 5, "a"), (20, None, "b"), (1000, 4, "c")], "addr long, size long, name string")
    addrs = spark.createDataFrame([(5,), (10,), (14,), (15,), (500,), (1003,), (1004,)], "addr long")
    got = {r.addr: r.symbol for r in joins.nearest_symbol(addrs, syms).collect()}
    assert got == {5: None, 10: "a", 14: "a", 15: None, 500: "b", 1003: "c", 1004: None}


def test_names(spark):
    one = spark.range(1)
    short = lambda x: one.select(N.short_kernel(F.lit(x))).first()[0]
    assert short("_Z3ZZ4solvPfE$_2") == "solv_2" and short("_ZZ9ab") == "_ZZ9ab" and short("plain") == "plain"
    assert one.select(N.jit_name(F.lit("1234567890.98765.jit.so"))).first()[0] == "[jit:567890…8765]"
    assert one.select(N.mpi_size(F.lit("MPI_DOUBLE")), N.backend(F.lit("omp"))).first()[:] == (8, "openmp")


def test_classes(spark):
    rows = [("x86-64", "vfmadd231ps", "ymm0", "compute"), ("x86-64", "movss", "xmm0, [rax]", "vec_sp"), ("x86-64", "lea", "rax, [rbx]", "memory"), ("x86-64", "vzeroupper", "", "scalar"), ("sass", "HFMA2", "R0", "scalar"), ("ptx", "atom.global", "", "sync"),
            ("rv64", "vle32.v", "v0", "vec_mem"), ("rv64", "fmadd.s", "", "compute"), ("rv64", "vadd.vv", "", "vector"), ("rv64", "lw", "", "memory"), ("arm64", "ldr", "x0, [x1]", "memory"), ("mips", "add", "", "other")]
    df = spark.createDataFrame(rows, "arch string, m string, o string, want string")
    assert df.where(classify(F.col("arch"), F.col("m"), F.col("o")) != F.col("want")).count() == 0


def test_advice(spark):
    rows = [("k", "sass", "LDG.E", "", "memory", 15)] * 8 + [("k", "sass", "IADD3", "", "scalar", 0)] * 24
    got = {r.rule for r in insns.advise(spark.createDataFrame(rows, "kernel string, arch string, mnemonic string, operands string, itype string, stall_cycles int")).collect()}
    assert got == {"global_without_shared", "low_compute", "high_stalls", "no_async_copy"}


def test_device_peaks(spark):
    cpu = roofline.cpu_peaks(spark.createDataFrame([(8, None, "sse4 avx2", None)], "cores int, core_clock_ghz double, flags string, bandwidth_gbs double")).first()
    assert abs(cpu.fp32_tflops - 8 * 3.0 * 8 * 2 / 1000) < 1e-12 and cpu.l3_bandwidth_gbs == 200.0
    gfx = roofline.rocm_peaks(spark.createDataFrame([(110, 1.7, 1.6, 4096, "gfx90a")], "sm_count int, core_clock_ghz double, mem_clock_ghz double, mem_bus_bits int, compute_cap string")).first()
    assert gfx.l2_bandwidth_gbs == 6400.0 and gfx.fp64_tflops == gfx.fp32_tflops / 2


def test_roofline_raster(spark, sf):
    metrics, device = roofline.from_counters(views.kernels(spark, sf), views.devices(spark).where("device_idx = 0")), views.devices(spark).where("device_idx = 0")
    lines = roofline.raster(metrics, device)
    assert len(lines) == 16 and any(c.isalpha() for x in lines for c in x)


def test_frames_with_source(spark):
    spans = spark.createDataFrame([(1, ["f|/lib.so|0x10", "g|/lib.so|0x20", "main"])], "seq long, stack_frames array<string>")
    symbols = spark.createDataFrame([("/lib.so", "0x10", "/src/a.c", 7)], "lib string, offset string, file string, line int")
    assert joins.annotate_frames(spans, symbols).first().stack_frames == ["f (a.c:7)|/lib.so|0x10", "g|/lib.so|0x20", "main"]


def test_tools(spark, sf):
    import json

    spans = views.spans(spark, sf)
    for name in ("get_hotspots", "get_memory_profile", "get_sync_analysis", "get_mpi_communication", "get_timeline_phases"):
        assert json.loads(tools.execute(spans, name))
    assert json.loads(tools.execute(spans, "get_kernel_details", {"name": "kernel"}))[0]["match_count"] > 0
    assert len(json.loads(tools.execute(spans, "query_spans", {"limit": 3}))) == 3
    assert "error" in json.loads(tools.execute(spans, "nope")) and "error" in json.loads(tools.execute(spans, "get_hotspots", {"x": 1}))
    assert len(tools.schema()) == 7


def test_positions(spark):
    """Values picked by position are those of sorting, however the values spread over ranges."""
    from tracewright.operators.ranks import pick

    rng = random.Random(2)
    rows = [(g, rng.randrange(10**12) if g == "a" else rng.randrange(5)) for g in "ab" for _ in range(1001)] + [("c", 7)]
    places = {"p50": lambda n: F.floor(n / 2), "p99": lambda n: F.least(F.floor(n * 0.99), n - 1)}
    want = {g: (v[len(v) // 2], v[min(int(len(v) * 0.99), len(v) - 1)]) for g in "abc" for v in [sorted(x for k, x in rows if k == g)]}
    df = spark.createDataFrame(rows, "g string, v long")
    assert {r.g: (r.p50, r.p99) for r in pick(df, "g", "v", places).collect()} == want


def test_running_over_ranges(spark):
    """Running sums and maxima are those of one long window, with null groups and repeated orders among many ranges."""
    from tracewright.operators.ranges import running

    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(-50, 50)) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for before in (False, True):
            got = running(df, ["g"], ["o"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, before).collect()
            want = {}
            for g in ("a", "b", None):
                seen = []
                for _, o, v in [r for r in rows if r[0] == g]:
                    upto = seen if before else [*seen, v]
                    want[o] = (sum(upto) if upto else None, max(upto, default=None))
                    seen.append(v)
            assert {r.o: (r.total, r.top) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_within_texts(spark):
    from tracewright.operators.joins import within

    small = ["", "a", "ab", "kernel", "kern", "xyz", "ns::copy_2"]
    large = ["kernel_1", "the kernel", "ns::copy_2_long", "", "b", "aab"]
    got = within(spark.createDataFrame([(x,) for x in small], "s string"), "s", spark.createDataFrame([(x,) for x in large], "t string"), "t").collect()
    assert {tuple(r) for r in got} == {(a, b) for a in small for b in large if a in b}


def test_containment_over_many_ranges(spark):
    """A thread that spreads over ranges, below a span that holds all of it, with links across."""
    rng = random.Random(4)
    rows = [("root", 1, 0, 10**6, "r", None)]
    for i in range(600):
        link = rng.choice([None, None, None, "r", "s5", "s77", f"s{rng.randrange(600)}"])
        rows.append((f"f{i % 5}", 1 if i % 4 else 2, rng.randrange(5000), rng.randrange(1, 300), f"s{i}", link))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = hierarchy.containment(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.seq: r.parent_seq for r in out}
    want = model_parents(rows)
    assert got == want
    for r in out:
        path, at, seen = [], r.seq, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.insert(0, rows[at][0])
            at = want[at]
        if at is None:  # no circle
            assert [x.split("\x1f")[0] for x in r.path] == path


def test_numbers_as_c_prints_them(spark):
    """Binary values are rounded, ties to even; Java would round their decimal text half up."""
    from pyspark.sql import functions as F

    from tracewright.functions import formats as X

    ns = [0.5, 2.5, -2.5, 1250.0, 1350.0, 1005000.0, 1e6, 1015000.0, 9.9995e8, 1000500000.0, 1.5e9, 2.0**70, 1e30, 36000062500.0]
    want = ["%.3fs" % (x / 1e9) if x >= 1e9 else "%.2fms" % (x / 1e6) if x >= 1e6 else "%.1fµs" % (x / 1e3) if x >= 1e3 else "%.0fns" % x for x in ns]
    assert [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(ns)], "i int, x double").orderBy("i").select(X.fmt_ns(F.col("x")).alias("t")).collect()] == want
    tf = [1250.0, 1.25, 2.25, 0.0625, 0.0025, 1.15e-5, 1.25e-5, 1.45e-7, 8.35e-9, 0.0]
    want = ["%.1f PF" % (x / 1000) if x >= 1000 else "%.1f TF" % x if x >= 1 else "%.0f GF" % (x * 1000) if x >= 0.001 else "%.1e TF" % x for x in tf]
    assert [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(tf)], "i int, x double").orderBy("i").select(X.fmt_tflops(F.col("x")).alias("t")).collect()] == want


def test_summary_columns_keep_their_width(spark):
    from tracewright.plans.catalog_formats import summary

    rows = [(1, "kernel_name", "a long category", 0, 60_000_000 * 10**9, 60_000_000 * 10**9, 0, 0, {}, [])]
    spans = spark.createDataFrame(rows, "seq long, name string, category string, start_ns long, duration_ns long, end_ns long, pid long, tid long, tags map<string,string>, stack_frames array<string>")
    line = lambda **k: summary.summary(spans, **k).split("\n")[1]
    assert line() == "  a long category          1 60000000.000s" and line(exact=True) == "  a long categ          1 60000000.000"
