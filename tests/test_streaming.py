"""Streams give what batches give."""

import random

from pyspark.sql import functions as F

from tracewright.sources import wire
from tracewright.streaming import ingest, pairing


def run(df, mode="append"):
    name = f"t{random.randrange(10**9)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def records(tmp_path, n=60):
    a, b = [], []
    for i in range(n):
        t = 1_700_000_000_000_000_000 + i * 100_000_000
        a.append(f"span:cuda:1:{i % 3}:{t}:{50 + i}:k{i % 4}:type=kernel")
        if i % 2:
            a.append(f"stk:1:{i % 3}:{t}:f{i};main")
        a.append(f"ctr:memory:1:{t}:gpu:{i}:bytes")
    end = 1_700_000_100_000_000_000
    b.append(f"span:cuda:1:0:{end}:1:last")
    b.append(f"stk:1:0:{end}:main")
    b.append(f"ctr:memory:1:{end}:gpu:0:bytes")
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("\n".join(a[: len(a) // 2]) + "\n")
    (d / "b.txt").write_text("\n".join(a[len(a) // 2 :]) + "\n")
    (d / "c.txt").write_text("\n".join(b) + "\n")
    return str(d)


def test_hotspots(spark, tmp_path):
    path = records(tmp_path)
    got = run(ingest.hotspots(ingest.spans(ingest.lines(spark, path, 1))), "complete")
    want = ingest.hotspots(wire.spans(wire.parse(spark.read.text(path))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_attach(spark, tmp_path):
    path = records(tmp_path)
    stream = ingest.lines(spark, path)
    got = run(ingest.attach(ingest.spans(stream), ingest.stacks(ingest.lines(spark, path)), "1 second")).where("size(stack_frames) > 0")
    assert got.count() == 31 and {r.stack_frames[-1] for r in got.collect()} == {"main"}


def test_windows(spark, tmp_path):
    path = records(tmp_path)
    got = run(ingest.gauges(ingest.counters(ingest.lines(spark, path)), "1 second", "1 second"))
    assert sorted((r.peak, r.points) for r in got.collect()) == [(9.0 + 10 * i, 10) for i in range(6)]
    phases = run(ingest.phases(ingest.spans(ingest.lines(spark, path)), "5 seconds", "1 second"))
    assert [r.spans for r in phases.collect()] == [60]


MARKS = "pid long, tid long, seq long, timestamp_ns long, kind string, name string"


def marks(n=200):
    rng, rows, depth = random.Random(5), [], {0: 0, 1: 0}
    for i in range(n):
        t = rng.randrange(2)
        kind = "begin" if rng.random() < 0.55 else "end"
        if kind == "end" and depth[t] == 0:
            kind = "begin"
        depth[t] += 1 if kind == "begin" else -1
        rows.append((1, t, i, i * 10, kind, f"n{i}"))
    return rows


def model(rows):
    out, stacks = [], {}
    for pid, tid, _, at, kind, name in rows:
        s = stacks.setdefault((pid, tid), [])
        if kind == "begin":
            s.append((name, at))
        elif s:
            n, a = s.pop()
            out.append((pid, tid, n, a, at - a, len(s) + 1))
    return sorted(out)


def test_pairs(spark, tmp_path):
    rows = marks()
    df = spark.createDataFrame(rows, MARKS)
    assert sorted(map(tuple, pairing.pair(df).collect())) == model(rows)
    d = str(tmp_path / "m")
    df.where("seq < 90").coalesce(1).write.parquet(d)
    df.where("seq >= 90").coalesce(1).write.mode("append").parquet(d)
    stream = spark.readStream.schema(MARKS).parquet(d)
    assert sorted(map(tuple, run(pairing.pair_stream(stream)).collect())) == model(rows)


def test_lost_ends(spark):
    rows = [(1, 1, 0, 0, "end", "x"), (1, 1, 1, 10, "begin", "a"), (1, 1, 2, 30, "end", "a"), (1, 1, 3, 40, "end", "y"), (1, 1, 4, 50, "begin", "b"), (1, 1, 5, 60, "begin", "c"), (1, 1, 6, 70, "end", "c")]
    assert sorted(map(tuple, pairing.pair(spark.createDataFrame(rows, MARKS)).collect())) == model(rows)


def test_allocations(spark):
    rows = [(0, 0, "alloc", 1, 100), (1, 1, "alloc", 2, 50), (2, 2, "free", 1, None), (3, 3, "free", 9, None), (4, 4, "alloc", 1, 7), (5, 5, "free", 2, None), (6, 6, "free", 2, None)]
    df = spark.createDataFrame(rows, "seq long, timestamp_ns long, kind string, ptr long, bytes long")
    assert [r.live_bytes for r in pairing.allocation_balance(df).orderBy("seq").collect()] == [100, 150, 50, 50, 57, 7, 7]
    assert [tuple(r) for r in pairing.leaks(df).collect()] == [(1, 7)]


def test_requests_and_clocks(spark):
    t = "timestamp'2024-01-01 00:00:0"
    begun = spark.sql(f"SELECT * FROM VALUES (1L, 'MPI_Isend', 10L, {t}1'), (2L, 'MPI_Irecv', 20L, {t}2') AS t(req_id, name, start_ns, event_time)")
    waited = spark.sql(f"SELECT * FROM VALUES (1L, 'MPI_Wait', 15L, {t}3') AS t(req_id, name, start_ns, event_time)")
    assert [tuple(r) for r in pairing.requests(begun, waited).collect()] == [(1, "MPI_Isend", 10, "MPI_Wait", 5)]
    events = spark.createDataFrame([("d", 1, 100, 1000), ("d", 2, 150, 1100), ("e", 3, 5, 5)], "device string, seq long, device_ns long, host_ns long")
    assert {(r.device, r.seq): r.time_ns for r in pairing.calibrated(events).collect()} == {("d", 1): 1000, ("d", 2): 1050, ("e", 3): 5}
    assert F is not None
