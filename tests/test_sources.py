"""Golden fixtures for every reader."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import activity, roofline
from tracewright.sinks import otlp, report, summary, trace_json as sink
from tracewright.sources import disasm, perf, tools, trace_json, wire

RECORDS = """span:nvtx:7:1:1000:900:step:type=nvtx_range,sid=41
span:cuda:7:1:1100:300:k_add:type=kernel,grid=4x2x1,block=128x1x1,stream=1,psid=41
stk:7:1:1100:launch|/app|0x10;solve::run;main
span:cuda:7:1:1300:300:k_mul:type=kernel,grid=8x1x1,block=64x1x1,stream=2,psid=41
span:memory:7:1:1700:50:copy_async:type=memcpy_async,bytes=4096,stream=1
span:cuda:7:1:1760:40:copy_sync:type=memcpy,dir=H2D,bytes=8192
span:sync:7:1:1800:80:cudaDeviceSynchronize:type=sync,psid=41
span:mpi:7:1:1900:5:MPI_Isend:type=isend,bytes=64,rank=0,peer=1,tag=3,sid=1
span:mpi:7:1:1910:20:MPI_Wait:type=wait,rank=0,psid=1
span:annotation:7:2:1000:10:mark:type=roctx_range
span:nvtx:7:2:1000:10:a::b:type=nvtx_range
inst:cuda:7:1:1200:tick
ctr:memory:7:1150:gpu_memory_bytes:4096:bytes
pcsa:7:2000:k_add:1a0:4:12
span:cuda:x:1:1:1:bad
stk:7:1:9999:orphan
"""


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("wire") / "r.txt"
    p.write_text(RECORDS)
    return {k: v.cache() for k, v in wire.load(spark, str(p)).items()}


def whole(spark, text, file="f"):
    return spark.createDataFrame([(file, text)], "file string, value string")


def test_wire(trace):
    spans = {r.name: r for r in trace["spans"].collect()}
    assert len(spans) == 10 and trace["spans"].count() == 10 and spans["a"].tags == {":b:type": "nvtx_range"} and spans["mark"].category == "other"
    assert spans["step"].span_id == "41" and spans["k_add"].parent_span_id == "41" and spans["k_add"].tags["grid"] == "4x2x1"
    assert spans["k_add"].stack_frames == ["launch|/app|0x10", "solve::run", "main"] and spans["k_mul"].stack_frames == []
    assert [r.value for r in trace["quarantine"].collect()] == ["span:cuda:x:1:1:1:bad"]
    c = trace["counters"].first()
    assert (c.name, c.value, c.unit) == ("gpu_memory_bytes", 4096.0, "bytes")
    p = trace["pc_samples"].first()
    assert (p.func_name, p.pc_offset, p.stall_reason, p["count"]) == ("k_add", 0x1A0, 4, 12)
    assert trace["instants"].first().name == "tick"


def test_wire_starvation(trace):
    g = activity.gpu_starvation(trace["spans"]).first()
    assert (g.wall_ns, g.gpu_active_ns, g.sync_stall_ns, g.sync_calls, g.launch_gap_ns) == (930, 540, 80, 1, 310)
    assert activity.request_pairs(trace["spans"]).first().linked_pairs == 1


def test_greedy_names(spark):
    parsed = wire.parse(spark.createDataFrame([(1, "span:nvtx:7:2:1000:10:a::b:type=x")], "seq long, value string"))
    assert wire.spans(parsed, greedy_name=True).first().name == "a::b" and wire.spans(parsed).first().name == "a"


def test_trace_json_round_trip(spark, trace, tmp_path):
    doc = sink.document(sink.events(trace["spans"], trace["instants"], trace["counters"]), {"command": "app", "args": [], "devices": [{"name": "g", "backend": "cuda", "fp32_tflops": 1.5}]})
    p = tmp_path / "t.json"
    p.write_text(doc)
    back = trace_json.load(spark, str(p))
    cols = ["name", "category", "start_ns", "duration_ns", "pid", "tid", "stack_frames", "span_id", "parent_span_id"]
    key = lambda df: sorted(map(str, df.select(*cols, F.to_json("tags").alias("t")).collect()))
    assert key(back["spans"]) == key(trace["spans"])
    c = back["counters"].first()
    assert (c.value, c.unit, c.timestamp_ns) == (4096.0, "bytes", 1150)
    assert back["devices"].first().fp32_tflops == 1.5 and back["meta"].first().command == "app"
    sink.write_lines(sink.events(trace["spans"]), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 10


def test_otlp(trace):
    import json

    rows = [json.loads(r.payload) for r in otlp.traces_payload(trace["spans"], "app", 5, "h", 1_000_000).collect()]
    spans = [s for r in rows for sc in r["resourceSpans"][0]["scopeSpans"] for s in sc["spans"]]
    assert len(spans) == 10
    by = {s["name"]: s for s in spans}
    assert by["k_add"]["parentSpanId"] == by["step"]["spanId"] == f"{41:016x}" and by["k_add"]["startTimeUnixNano"] == "1001100"
    kinds = {a["key"]: a["value"] for a in by["copy_async"]["attributes"]}
    assert kinds["tag.bytes"] == {"intValue": "4096"} and kinds["tag.type"] == {"stringValue": "memcpy_async"} and len(by["step"]["traceId"]) == 32
    m = json.loads(otlp.metrics(trace["counters"]).first().payload)
    assert m["unit"] == "bytes" and m["gauge"]["dataPoints"][0]["asDouble"] == 4096.0
    assert "Hotspots" in summary.summary(trace["spans"], trace["counters"])


PERF = """app 10/11 1.500000: 1 cycles:u:
\t 4005d0 inner+0x10 (/app)
\t 4004f0 main+0x20 (/app)

app 10/12 1.600000: 1 cycles:u:
\t 4004f0 main+0x20 (/app)
\t ffff [unknown] (/x)
"""


def test_perf_stacks(spark, tmp_path):
    (tmp_path / "p.txt").write_text(PERF)
    found = perf.samples(perf.read(spark, str(tmp_path / "p.txt"))).cache()
    rows = sorted((r.tid, r.start_ns, r.frames) for r in found.collect())
    assert rows == [(11, 1_500_000_000, ["main", "inner"]), (12, 1_600_000_000, ["main"])]
    assert sorted(r.name for r in perf.spans(found).collect()) == ["inner", "main", "main"]
    assert {r.stack: r["count"] for r in perf.folded(found).collect()} == {"app;main;inner": 1, "app;main": 1}


def test_perf_flat(spark, tmp_path):
    (tmp_path / "p.txt").write_text("app 10 1.5: 1 cycles:u: 4005d0 inner (/app)\napp 10 1.7: 1 cycles:u: 4005d0 [unknown] (/app)\n")
    rows = perf.spans(perf.samples(perf.read(spark, str(tmp_path / "p.txt")))).collect()
    assert sorted(r.name for r in rows) == ["[cpu]", "inner"] and all(r.tid == 10 for r in rows)


def test_folded(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a;b 3\n\nbad\nx;y z\na;;b 2\n")
    assert {r.stack: r["count"] for r in perf.read_folded(spark, str(tmp_path / "f.txt")).collect()} == {"a;b": 3, "a;;b": 2}


def test_perf_stat(spark):
    text = " 2,000,000      cycles:u\n 3,000,000      instructions:u\n 1,000      cache-references\n 50      cache-misses\n 100  fp_arith_inst_retired.scalar_single:u\n 10  fp_arith_inst_retired.256b_packed_double\n 7  LLC-load-misses\n 9  LLC-loads\n 4  uncore_imc/cas_count_read/\n\n 1.5 seconds time elapsed\n"
    t = whole(spark, text)
    assert {r.name: r.value for r in perf.microarch(t).collect()} == {"ipc": 1.5, "cache_miss_pct": 5.0}
    a = perf.intel(t).first()
    assert (a.fp32_ops, a.fp64_ops, a.dram_bytes, a.l3_bytes, a.duration_ns, a.source) == (100.0, 40.0, 448.0, 576.0, 1_500_000_000, "perf_llcproxy")
    assert perf.intel(t, True).first().dram_bytes == 256.0
    b = perf.amd(whole(spark, "100  fp_ret_sse_avx_ops.all\n 10  fp_ret_sse_avx_ops.fp64_mult_add_ops\n")).first()
    assert (b.fp32_ops, b.fp64_ops) == (80.0, 20.0)


def test_ncu(spark, tmp_path):
    lines = ["==PROF== x", '"ID","Kernel Name","Metric Name","Metric Value"']
    values = {"sm__sass_thread_inst_executed_op_ffma_pred_on.sum": "1,024", "sm__sass_thread_inst_executed_op_fadd_pred_on.sum": "10", "dram__bytes.sum": "1 000", "sm__cycles_elapsed.max": "100", "sm__cycles_elapsed.sum": "400", "sm__inst_executed.sum": "800", "sm__warps_active.avg.pct_of_peak_sustained_active": "50"}
    for run in range(2):
        lines += [f'"{run}","k, one","{k}","{v}"' for k, v in values.items()]
    (tmp_path / "n.csv").write_text("\n".join(lines) + "\n")
    r = tools.ncu(tools.read_csv(spark, str(tmp_path / "n.csv"))).first()
    assert (r.kernel_name, r.fp32_ops, r.dram_bytes, r.sm_cycles_max, r.occupancy_pct, r.ipc) == ("k, one", 2 * (2048.0 + 10), 2000.0, 200.0, 50.0, 2.0)


def test_rocprof(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Kernel-Name,SQ_INSTS_VALU_ADD_F32,SQ_INSTS_VALU_FMA_F32,TCC_EA_RDREQ_sum,TCC_EA_RDREQ_32B_sum,TCC_EA_WRREQ_sum,TCC_EA_WRREQ_32B_sum,TCC_HIT_sum,TCC_MISS_sum,BeginNs,EndNs\nk,10,5,4,1,2,0,3,1,100,400\n,1,1,1,1,1,1,1,1,1,1\n")
    rows = tools.rocprof(tools.read_csv(spark, str(tmp_path / "r.csv"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.fp32_ops, r.dram_bytes, r.l2_bytes, r.duration_ns) == (20.0, 32 + 3 * 64 + 2 * 64, 256.0, 300)


def test_likwid(spark):
    text = "TABLE,Group 1 Raw,FLOPS_DP,x\nMetric,core 0,core 1,Sum\nRuntime (RDTSC) [s],2.0,2.0,4.0\nDP [MFLOPS/s],100,200,300\nTABLE,Group 2,MEM_DP\nMemory data volume [GBytes],0.5\n"
    t = whole(spark, text)
    rows = tools.likwid_table(t, "FLOPS_DP").unionByName(tools.likwid_table(t, "MEM_DP"))
    assert {(r.group, r.metric): r.value for r in rows.collect()} == {("FLOPS_DP", "Runtime (RDTSC) [s]"): 4.0, ("FLOPS_DP", "DP [MFLOPS/s]"): 300.0, ("MEM_DP", "Memory data volume [GBytes]"): 0.5}
    c = roofline.likwid_counters(rows).first()
    assert (c.fp64_ops, c.dram_bytes, c.duration_ns) == (300 * 4 * 1e6, 5e8, 4_000_000_000)


def test_likwid_ascii(spark):
    text = "+---+\n|        Metric        |   Core 0   |  Core 1 |\n+----+----+\n| Clock [MHz] | 2,5 | 3.5 |\n| CPI | 1.0 | 2.0 |\n+----+\nrest\n| x | 1 | 2 |\n"
    rows = {r.name: r.value for r in tools.likwid_counters(tools.likwid_metrics(whole(spark, text))).collect()}
    assert rows == {"likwid.core0.clock": 2.5, "likwid.core1.clock": 3.5, "likwid.core0.cpi": 1.0, "likwid.core1.cpi": 2.0, "likwid.total.clock": 6.0, "likwid.avg.cpi": 1.5}


def test_polling(spark):
    rows = {r.name: r.value for r in tools.nvidia_smi(spark.createDataFrame([("0, 50, 20, 1024",), ("bad",), ("1, x, 2, 3",)], "value string")).collect()}
    assert rows == {"gpu_utilization_pct[gpu0]": 50.0, "gpu_mem_util_pct[gpu0]": 20.0, "gpu_mem_used_bytes[gpu0]": 1024.0 * 1024**2}
    use = {r.name: r.value for r in tools.rocm_smi(whole(spark, "device,GPU use (%)\ncard0,33\ncard1,44%\n"), "use").collect()}
    assert use == {"gpu_utilization_pct[gpu0]": 33.0, "gpu_utilization_pct[gpu1]": 44.0}
    mem = {r.name: r.value for r in tools.rocm_smi(whole(spark, "# c\ndevice,VRAM Total (MB),VRAM Used (MB)\ncard0,100,7\n"), "mem").collect()}
    assert mem == {"gpu_mem_used_bytes[gpu0]": 7.0 * 1024**2}


def test_disassembly(spark):
    sass = "\tFunction : k1\n /*0000*/  LDG.E R0, [R2] ;  /* 0x000001 */\n  /* 0x000fc40000000f00 */\n /*0010*/ @!P0 FFMA R0, R1, R2, R3 ;\n  /* 0x000fc40000000200 */\nFunction : k2\n /*0000*/ EXIT ;\n"
    rows = sorted((r.kernel, r.addr, r.mnemonic, r.itype, r.stall_cycles) for r in disasm.sass(whole(spark, sass)).collect())
    assert rows == [("k1", 0, "LDG.E", "memory", 15), ("k1", 16, "FFMA", "compute", 2), ("k2", 0, "EXIT", "control", -1)]
    ptx = ".visible .entry kern(\n)\n{\n\tld.global.f32 %f1, [%rd1];\n\tret;\n}\n"
    assert [(r.kernel, r.mnemonic, r.itype) for r in disasm.ptx(whole(spark, ptx)).orderBy("pos").collect()] == [("kern", "ld.global.f32", "memory"), ("kern", "ret", "control")]
    gcn = "<kern>:\n  0010: v_fma_f32 v0, v1\n  0018: s_endpgm\n"
    assert [(r.addr, r.itype) for r in disasm.amdgcn(whole(spark, gcn)).orderBy("pos").collect()] == [(16, "vec_sp"), (24, "control")]
    obj = "0000000000401000 <foo(int)>:\n  401000:\tvaddps ymm0,ymm1,ymm2\n  401004:\tmov    rax,QWORD PTR [rbx]  # c\n0000000000402000 <bar>:\n  402000:\tret\n"
    assert [(r.kernel, r.mnemonic, r.itype, r.comment) for r in disasm.objdump(whole(spark, obj), "foo").orderBy("pos").collect()] == [("foo(int)", "vaddps", "vec_sp", ""), ("foo(int)", "mov", "memory", "c")]
    nm = spark.createDataFrame([("0000000000001000 0000000000000010 T f",), ("2000 20 d data",), ("3000 W g",), ("bad",)], "value string")
    assert sorted((r.addr, r.size, r.name) for r in disasm.symbols(nm).where("size is not null").collect()) == [(0x1000, 0x10, "f")]


def test_source_positions(spark):
    dwarf = "CU: a.cu:\nFile name    Line number    Starting address\na.cu    12    0x10\na.cu    13    0x20\n"
    assert sorted(tuple(r) for r in disasm.dwarf_lines(whole(spark, dwarf)).collect()) == [(16, "a.cu", 12), (32, "a.cu", 13)]
    listing = "; a.cpp:42\n  0010: x\n; a.cpp:43\n  0018: y\n"
    assert sorted(tuple(r) for r in disasm.listing_lines(whole(spark, listing)).collect()) == [(16, "a.cpp", 42), (24, "a.cpp", 43)]
    ptx = '.file 1 "k.cu"\n.loc 1 7 0\n/*0010*/ add;\n'
    assert [tuple(r) for r in disasm.ptx_lines(whole(spark, ptx)).collect()] == [(16, "k.cu", 7)]
    out = disasm.resolved(whole(spark, "f\n/src/a.c:3\ng\n??:0\n"), "/lib", spark.createDataFrame([(0, "0x1"), (1, "0x2")], "pos int, addr string"))
    assert [tuple(r) for r in out.collect()] == [("/lib", "0x1", "/src/a.c", 3)]
    notes = spark.createDataFrame([("  12.34 :  40a100:  mov rax",), ("  0.00 :  40a104:  ret",)], "value string")
    assert [tuple(r) for r in disasm.perf_annotate(notes).collect()] == [(0x40A100, 12.34)]


def test_trace_lines(spark, trace, tmp_path):
    """A document with an event a line is read line by line, brackets and all."""
    events = [r.json for r in sink.events(trace["spans"], trace["instants"], trace["counters"]).orderBy("order").select("json").collect()]
    for k, (head, tail) in enumerate([('{"traceEvents":[', '],"displayTimeUnit":"ms"}'), ("[", "]"), ("[\n", "\n]"), ('{"traceEvents": [', "]}")]):
        (tmp_path / f"t{k}.json").write_text(head + ",\n".join(events) + tail)
        rows = trace_json.read_lines(spark, str(tmp_path / f"t{k}.json"))
        assert rows.count() == len(events)
        key = lambda df: sorted(map(str, df.select("name", "category", "start_ns", "duration_ns", "span_id", F.to_json("tags"), F.to_json("stack_frames")).collect()))
        assert key(trace_json.spans(rows)) == key(trace["spans"])


def test_sending(trace):
    """Payloads arrive at a receiver, and what it refuses is an error."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got, answer = [], [200]

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(answer[0])
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    payloads = otlp.traces_payload(trace["spans"], "app")
    assert otlp.send(payloads, url) == payloads.count() == len(got) and {p for p, _ in got} == {"/v1/traces"}
    assert sum(len(sc["spans"]) for _, b in got for sc in b["resourceSpans"][0]["scopeSpans"]) == 10
    got.clear()
    assert otlp.send(otlp.metrics_payload(trace["counters"]), url, "metrics") == 1
    assert got[0][0] == "/v1/metrics" and got[0][1]["resourceMetrics"][0]["scopeMetrics"][0]["metrics"][0]["gauge"]["dataPoints"][0]["asDouble"] == 4096.0
    answer[0] = 500
    with pytest.raises(RuntimeError, match="were not taken"):
        otlp.send(payloads, url)
    server.shutdown()
    with pytest.raises(RuntimeError, match="were not taken"):
        otlp.send(payloads, "http://127.0.0.1:9", timeout=2)


def test_report(trace, tmp_path):
    text = report.markdown(trace["spans"], about={"Command": "app"}, notes="* nothing")
    assert text.startswith("# Performance report\n\n**Command:** app  \n") and "## GPU" in text and text.endswith("## Findings\n\n* nothing\n")
    assert "| cudaDeviceSynchronize | 1 | 80ns | 100.0 % |" in text
    report.write(f"file://{tmp_path}/r.md", text, trace["spans"])
    assert (tmp_path / "r.md").read_text() == text


def test_sample_order_has_no_limit(spark):
    """Frames are numbered in order of arrival in blocks far apart and below deep stacks."""
    deep = "\n".join(f"\t 4005{i:04x} f{i} (/app)" for i in range(400))
    rows = [(b, f"app 1 {k}.5: 1 cycles:u:\n{deep}") for k, b in enumerate((0, 70 << 33, 900 << 33))]
    got = perf.spans(perf.samples(spark.createDataFrame(rows, "block long, value string"))).orderBy("seq").collect()
    assert len({r.seq for r in got}) == len(got) == 1200 and [(r.start_ns, int(r.tags["depth"])) for r in got] == [(k * 10**9 + 5 * 10**8, i) for k in range(3) for i in range(400)]


def test_headers_by_position(spark):
    rows = [(1, "my tool  7/8 [003] 2.25: 100 page-faults: 4005d0 operator()(int, char) const+0x1 (/a b.so)"), (2, "x 9 3.5: cycles: add"), (3, "no time stamp here"), (4, "")]
    got = sorted((r.block, r.comm, r.pid, r.tid, r.start_ns, r.symbol) for r in perf.samples(spark.createDataFrame(rows, "block long, value string")).collect())
    assert got == [(1, "my tool", 7, 8, 2_250_000_000, "operator()(int, char) const"), (2, "x", 9, 9, 3_500_000_000, "add")]


def test_lines_of_split_files(spark, tmp_path):
    """Lines are numbered in order however files are cut into splits."""
    from tracewright.sources import lines

    for name, n in (("a", 3000), ("b", 1), ("c", 500)):
        (tmp_path / name).write_text("".join(f"{name}{i}\r\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = lines.numbered(spark, str(tmp_path)).collect()
        seq = sorted((r.seq, r.value.rstrip()) for r in lines.sequenced(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(rows) == 3501 and all(r.value == f"{r.file[-1]}{r.pos}" for r in rows)
    assert seq == list(enumerate(f"{name}{i}" for name, n in (("a", 3000), ("b", 1), ("c", 500)) for i in range(n)))
