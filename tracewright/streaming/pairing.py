"""Pairing of begin and end records, requests and waits, allocations and frees, clocks.

Batch forms are windows and joins.  The streaming form of begin/end pairing
keeps a stack for each thread in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranges import running

PAIRS = "pid long, tid long, name string, start_ns long, duration_ns long, depth int"


def pair(marks: DataFrame) -> DataFrame:
    """Spans from marks (pid, tid, seq, timestamp_ns, kind begin|end, name): an end closes its thread's latest open begin.

    The depth after each mark is a running sum; a begin and the end that closes
    it are neighbours among the marks of their depth.  Sums and neighbours are found over
    ranges of marks, so a thread of any length spreads over tasks.
    """
    by = ["pid", "tid"]
    step = F.when(F.col("kind") == "begin", 1).otherwise(-1)
    rows = running(marks.select(*by, "seq", "timestamp_ns", "kind", "name"), by, ["seq"], {"sum_": ("sum", step)})
    # ends without a begin don't take the depth below zero
    rows = running(rows, by, ["seq"], {"down_": ("max", -F.col("sum_"))})
    after = F.col("sum_") - F.least(-F.col("down_"), F.lit(0))
    rows = rows.withColumn("level", F.when(F.col("kind") == "begin", after).otherwise(after + 1)).withColumn("back_", -F.col("seq"))
    # counted backwards, the next mark is the last one before
    rows = running(rows, [*by, "level"], ["back_"], {"next_": ("max", F.struct("back_", "kind", "timestamp_ns"))}, before=True)
    out = rows.where("kind = 'begin' and next_.kind = 'end'")
    return out.select("pid", "tid", "name", F.col("timestamp_ns").alias("start_ns"), (F.col("next_.timestamp_ns") - F.col("timestamp_ns")).alias("duration_ns"), F.col("level").cast("int").alias("depth"))


def _close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pid, tid = key
    stack = list(zip(*state.get)) if state.exists else []
    out = []
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for r in rows.itertuples():
        if r.kind == "begin":
            stack.append((r.name, int(r.timestamp_ns)))
        elif stack:
            name, start = stack.pop()
            out.append((pid, tid, name, start, int(r.timestamp_ns) - start, len(stack) + 1))
    state.update(([s[0] for s in stack], [s[1] for s in stack]))
    yield pd.DataFrame(out, columns=["pid", "tid", "name", "start_ns", "duration_ns", "depth"])


def pair_stream(marks: DataFrame) -> DataFrame:
    """The same of a stream; each thread's open begins are its state.  Marks of a batch are put in order of ``seq``."""
    return marks.select("pid", "tid", "seq", "timestamp_ns", "kind", "name").groupBy("pid", "tid").applyInPandasWithState(_close, PAIRS, "names array<string>, starts array<long>", "append", GroupStateTimeout.NoTimeout)


def allocation_balance(ops: DataFrame) -> DataFrame:
    """Live bytes after each operation (seq, timestamp_ns, kind alloc|free, ptr, bytes): a free gives back what its pointer's latest allocation took."""
    w = Window.partitionBy("ptr").orderBy("seq")
    before = F.lag(F.struct("kind", "bytes")).over(w)
    rows = ops.withColumn("b_", before)
    delta = F.when(F.col("kind") == "alloc", F.col("bytes")).when(F.col("b_.kind") == "alloc", -F.col("b_.bytes")).otherwise(0)
    rows = rows.withColumn("delta", delta.cast("bigint"))
    out = running(rows.select("seq", "timestamp_ns", "kind", "ptr", "delta"), [], ["seq"], {"live_bytes": ("sum", F.col("delta"))})
    return out.withColumn("live_bytes", F.col("live_bytes").cast("bigint"))


def leaks(ops: DataFrame) -> DataFrame:
    """ptr, bytes of allocations that nothing freed."""
    last = ops.groupBy("ptr").agg(F.max_by(F.struct("kind", "bytes"), "seq").alias("s"))
    return last.where("s.kind = 'alloc'").select("ptr", F.col("s.bytes").alias("bytes"))


def requests(begun: DataFrame, waited: DataFrame, late: str | None = None) -> DataFrame:
    """Requests (req_id, name, start_ns, event_time) with what waited for them; streams need ``late``."""
    a, b = begun, waited.select(F.col("req_id").alias("w_id"), F.col("name").alias("w_name"), F.col("start_ns").alias("w_start"), F.col("event_time").alias("w_time"))
    if late:
        a, b = a.withWatermark("event_time", late), b.withWatermark("w_time", late)
    on = (F.col("req_id") == F.col("w_id")) & (F.col("w_time") >= F.col("event_time")) & (F.col("w_time") <= F.col("event_time") + F.expr("INTERVAL 1 HOUR"))
    return a.join(b, on).select("req_id", "name", "start_ns", F.col("w_name").alias("waited_by"), (F.col("w_start") - F.col("start_ns")).alias("latency_ns"))


def calibrated(events: DataFrame) -> DataFrame:
    """Device timestamps on the host's clock: each device's first observation (device, seq, device_ns, host_ns) fixes its offset."""
    first = events.groupBy("device").agg(F.min_by(F.col("host_ns") - F.col("device_ns"), "seq").alias("offset_ns"))
    return events.join(first, "device").withColumn("time_ns", F.col("device_ns") + F.col("offset_ns"))


def flushed(launches: DataFrame, syncs: DataFrame) -> DataFrame:
    """GPU work (pid, stream, seq) with the synchronisation that waits for it: the next one of its stream, or of all streams (stream null).

    ``flush_seq`` is null for what nothing waited for.  Work waits in no buffer here, so there is no
    bound on how much of it may be pending.
    """
    from ..operators.joins import nearest_symbol

    def following(by: list[str], ends: DataFrame) -> DataFrame:
        """seq and the first end behind it: the last one before it, counted backwards."""
        at = launches.select(*by, (-F.col("seq")).alias("addr"))
        found = nearest_symbol(at, ends.select(*by, (-F.col("seq")).alias("addr"), F.col("seq").cast("string").alias("name")), by)
        return found.select(*by, (-F.col("addr")).alias("seq"), F.col("symbol").cast("bigint").alias("end_"))

    own = following(["pid", "stream"], syncs.where("stream is not null")).select("seq", F.col("end_").alias("own_"))
    every = following(["pid"], syncs.where("stream is null")).select("seq", F.col("end_").alias("every_"))
    return launches.join(own, "seq").join(every, "seq").withColumn("flush_seq", F.least("own_", "every_")).drop("own_", "every_")
