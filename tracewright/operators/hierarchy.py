"""Parent links, containment call trees, cross-thread children."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .cct import prefixes
from .lineage import cut


def children_of(spans: DataFrame, n: int = 10) -> DataFrame:
    """The parents whose children take the most time."""
    parent = S.ids(spans).select(F.col("span_id").alias("pid_"), F.col("s.name").alias("parent"), F.col("s.category").alias("category"), F.col("s.duration_ns").alias("parent_ns"))
    kids = spans.where("parent_span_id is not null and parent_span_id <> ''").select("parent_span_id", "name", "duration_ns", "seq")
    total = kids.groupBy("parent_span_id").agg(F.count("*").alias("children"), F.sum("duration_ns").alias("children_ns"))
    # names in order of appearance: first by name (one row each), then by parent
    names = kids.groupBy("parent_span_id", "name").agg(F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("parent_span_id").orderBy("first"))
    names = names.withColumn("k", rank).where("k <= 5").groupBy("parent_span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("child_names"))
    top = total.join(parent, total.parent_span_id == parent.pid_).orderBy(F.desc("children_ns"), "parent_span_id").limit(n)
    pct = F.when(F.col("parent_ns") > 0, F.lit(100.0) * F.col("children_ns") / F.col("parent_ns")).otherwise(0.0)
    return top.join(names, "parent_span_id").select("parent_span_id", "parent", "category", "parent_ns", "children", "children_ns", pct.alias("pct_of_parent"), "child_names")


def cross_thread_children(spans: DataFrame) -> DataFrame:
    """Spans whose parent ran on another thread."""
    parent = S.ids(spans).select(F.col("span_id").alias("parent_span_id"), F.col("s.name").alias("parent"), F.col("s.pid").alias("ppid"), F.col("s.tid").alias("ptid"))
    both = spans.join(parent, "parent_span_id").where((F.col("pid") != F.col("ppid")) | (F.col("tid") != F.col("ptid")))
    return both.select("seq", "name", "pid", "tid", "parent", "ppid", "ptid", "duration_ns")


def depths(spans: DataFrame) -> DataFrame:
    """Depth of each span below its root along parent links, whatever it is; null where links lead in a circle.

    Pointer doubling: each round joins every span to its ancestor's ancestor, so
    the number of rounds is the logarithm of the greatest depth; lineage is cut
    between rounds.
    """
    last = S.ids(spans).select("span_id")
    link = spans.where("span_id is not null and span_id <> ''").groupBy("span_id").agg(F.max_by("parent_span_id", "seq").alias("parent"))
    known = last.select(F.col("span_id").alias("parent"), F.lit(True).alias("known"))
    link = link.join(known, "parent", "left").select("span_id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    state = link.select("span_id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    steps, state = 1, cut(state)
    number = state.count()
    while steps <= number and state.where("up is not null").limit(1).count():
        two = state.select(F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = cut(state.join(two, "up", "left").select("span_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
        steps *= 2
    return state.select("span_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


# ------------------------------------------------------------------ containment tree

_ROW = "pid long, tid long, seq long, name string, category string, start_ns long, end_ns long, duration_ns long, said long, part int"
_TREE = "pid long, tid long, seq long, name string, category string, duration_ns long, parent_seq long, fragment long, path array<string>"
_OPEN = "part int, pid long, tid long, first boolean, empty_at long, seqs array<long>, ends array<long>, keys array<string>, linked array<boolean>"


class _Stack:
    """The open spans of one thread, each with its path from the fragment it is in.

    A fragment is what hangs below a span with an explicit parent; its paths begin there.
    """

    def __init__(self) -> None:
        self.seqs: list[int] = []
        self.ends: list[int] = []
        self.keys: list[str] = []
        self.linked: list[bool] = []
        self.paths: list[list[str]] = []
        self.fragments: list[int | None] = []

    def close(self, now: int) -> None:
        """Spans that ended go, as long as they are on top."""
        while self.ends and self.ends[-1] <= now:
            for x in (self.seqs, self.ends, self.keys, self.linked, self.paths, self.fragments):
                x.pop()

    def push(self, seq: int, end: int, key: str, linked: bool) -> int | None:
        """Put a span on top; its parent is the one below, if that ends no sooner."""
        parent = None
        if linked:
            path, fragment = [key], seq
        elif self.ends and self.ends[-1] >= end:
            parent, path, fragment = self.seqs[-1], [*self.paths[-1], key], self.fragments[-1]
        else:
            path, fragment = [key], None
        for x, v in ((self.seqs, seq), (self.ends, end), (self.keys, key), (self.linked, linked), (self.paths, path), (self.fragments, fragment)):
            x.append(v)
        return parent


def _threads(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Thread and (seq, start, end, key, whether linked) of each row."""
    name, category = (["" if x is None else x for x in batch.column(c).to_pylist()] for c in (3, 4))
    pid, tid, seq, start, end = (batch.column(c).to_pylist() for c in (0, 1, 2, 5, 6))
    linked = batch.column(8).is_valid().to_pylist()
    for k in range(batch.num_rows):
        yield (pid[k], tid[k]), (seq[k], start[k], end[k], name[k] + "\x1f" + category[k], linked[k])


def _open_at_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a part leaves open of its first and of its last thread, and when nothing of its own was open last: then it closes what ended before."""
    out, now, stack, part, empty, first = [], None, _Stack(), 0, 0, True

    def keep() -> None:
        out.append((part, *now, first, empty, stack.seqs, stack.ends, stack.keys, stack.linked))

    for batch in batches:
        if batch.num_rows:
            part = batch.column(9)[0].as_py()
        for thread, (seq, start, end, key, linked) in _threads(batch):
            if thread != now:
                if now is not None and first:
                    keep()
                first, now, stack = now is None, thread, _Stack()
            stack.close(start)
            if not stack.ends:
                empty = start
            stack.push(seq, end, key, linked)
    if now is not None:
        keep()
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_())]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], [c.split()[0] for c in _OPEN.split(", ")])


def _carried(left_open: list) -> dict[int, tuple]:
    """For each part, its first thread's open spans from all parts before."""
    out: dict[int, tuple] = {}
    thread, stack = None, _Stack()
    for r in left_open:  # two rows a part at most, in order
        if (r.pid, r.tid) != thread:
            thread, stack = (r.pid, r.tid), _Stack()
        elif r.first and stack.ends:
            out[r.part] = (thread, list(stack.seqs), list(stack.ends), list(stack.keys), list(stack.linked))
        stack.close(r.empty_at)
        for x in zip(r.seqs, r.ends, r.keys, r.linked):
            stack.push(*x)
    return out


def _nested(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """Parents and paths of a part's spans, after what earlier parts left open."""
    now, stack = None, _Stack()
    for batch in batches:
        parents, fragments, paths = [], [], []
        for thread, (seq, start, end, key, linked) in _threads(batch):
            if thread != now:
                before = carried.get(batch.column(9)[0].as_py()) if now is None else None
                now, stack = thread, _Stack()
                if before is not None and before[0] == thread:
                    for x in zip(*before[1:]):
                        stack.push(*x)
            stack.close(start)
            parents.append(stack.push(seq, end, key, linked))
            fragments.append(stack.fragments[-1])
            paths.append(stack.paths[-1])
        said = batch.column(8)
        own = pc.if_else(said.is_valid(), said, pa.array(parents, pa.int64()))
        cols = [*(batch.column(c) for c in (0, 1, 2, 3, 4, 7)), own, pa.array(fragments, pa.int64()), pa.array(paths, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _TREE.split(", ")])


def containment(spans: DataFrame) -> DataFrame:
    """Each timed span with its parent in the thread's call tree and its path of names.

    The parent is the span that an explicit link names in the same thread, else the open span that
    holds this one.  Spans are dealt to ranges of (thread, start), so a thread of any size spreads
    over tasks.  A first pass finds what each range leaves open of its first and last thread - as much
    as spans nest; these stacks are put together on the driver, two for each range -, a second one finds the
    parents.  Paths below explicit links are completed by pointer doubling; links that lead in a circle add nothing to them.
    """
    rows = spans.where("duration_ns > 0").select("pid", "tid", "seq", "name", "category", "start_ns", "end_ns", "duration_ns", "span_id", "parent_span_id")
    named = rows.where("coalesce(span_id, '') <> ''").groupBy("pid", "tid", F.col("span_id").alias("parent_span_id")).agg(F.max_by("seq", F.struct("start_ns", "seq")).alias("said"))
    rows = rows.join(named, ["pid", "tid", "parent_span_id"], "left").withColumn("said", F.when(F.col("said") != F.col("seq"), F.col("said"))).drop("span_id", "parent_span_id")
    order = ("pid", "tid", "start_ns", "seq")
    names = [c.split()[0] for c in _ROW.split(", ")]
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select(*names))
    left_open = parts.mapInArrow(_open_at_the_end, _OPEN).collect()  # two rows a part at most
    carried = rows.sparkSession.sparkContext.broadcast(_carried(sorted(left_open, key=lambda r: (r.part, not r.first))))
    tree = parts.mapInArrow(lambda it: _nested(it, carried.value), _TREE)
    linked = parts.where("said is not null").select("seq", "said")
    if linked.limit(1).count() == 0:
        return tree.drop("fragment")
    tree = cut(tree)
    above = tree.select(F.col("seq").alias("said"), F.col("fragment").alias("up"), F.col("path").alias("pre"))
    state = cut(linked.join(above, "said").select(F.col("seq").alias("fragment"), "up", "pre"))
    steps, number = 1, state.count()
    while steps <= number and state.where("up is not null").limit(1).count():
        two = state.select(F.col("fragment").alias("up"), F.col("up").alias("up2"), F.col("pre").alias("pre2"))
        state = cut(state.join(two, "up", "left").select("fragment", F.col("up2").alias("up"), F.concat(F.coalesce("pre2", F.array().cast("array<string>")), "pre").alias("pre")))
        steps *= 2
    done = state.where("up is null").select("fragment", "pre")
    out = tree.join(done, "fragment", "left").withColumn("path", F.concat(F.coalesce("pre", F.array().cast("array<string>")), "path"))
    return out.select("pid", "tid", "seq", "name", "category", "duration_ns", "parent_seq", "path")


def call_tree(spans: DataFrame) -> DataFrame:
    """The containment tree with siblings of one name and category together: total, count, self time."""
    tree = containment(spans).groupBy("pid", "tid", "path").agg(F.sum("duration_ns").alias("total_ns"), F.count("*").alias("count"))
    below = tree.where(F.size("path") > 1).groupBy("pid", "tid", F.slice("path", 1, F.size("path") - 1).alias("path")).agg(F.sum("total_ns").alias("below_ns"))
    out = tree.join(below, ["pid", "tid", "path"], "left")
    leaf = F.split(F.element_at("path", -1), "\x1f")
    return out.select("pid", "tid", "path", (F.size("path") - 1).alias("depth"), leaf[0].alias("name"), leaf[1].alias("category"), "total_ns", "count", F.greatest(F.lit(0), F.col("total_ns") - F.coalesce("below_ns", F.lit(0))).alias("self_ns"))


def stack_tree(spans: DataFrame) -> DataFrame:
    """A tree of call stacks from main on: time of every prefix; the innermost frame has the count."""
    rows = spans.where("duration_ns > 0 and size(stack_frames) > 0").select(F.reverse("stack_frames").alias("path"), "name", "category", "duration_ns")
    by = rows.groupBy("path", "name", "category").agg(F.sum("duration_ns").alias("ns"), F.count("*").alias("n"))  # equal stacks once
    inner = prefixes(by.select("path", "category", "ns", "n"), "path", ["category", "ns", "n"])
    last = F.size("prefix") == F.col("full")
    inner = inner.select(F.col("prefix").alias("path"), F.when(last, F.col("category")).otherwise("other").alias("category"), "ns", F.when(last, F.col("n")).otherwise(0).alias("n"))
    leaf = by.select(F.concat("path", F.array(F.concat(F.lit("__leaf__"), F.col("name")))).alias("path"), "category", "ns", "n")
    every = inner.unionByName(leaf).groupBy("path").agg(F.max("category").alias("category"), F.sum("ns").alias("total_ns"), F.sum("n").alias("count"))
    return every.withColumn("depth", F.size("path") - 1)


def trace_tree(spans: DataFrame) -> DataFrame:
    """Stacks if the trace has any, else containment by thread below a root for each thread."""
    if spans.where("duration_ns > 0 and size(stack_frames) > 0").limit(1).count():
        return stack_tree(spans).select("path", "depth", "category", "total_ns", "count")
    tree = call_tree(spans)
    root = F.concat(F.lit("Thread "), F.col("tid").cast("string"), F.lit(" (pid "), F.col("pid").cast("string"), F.lit(")"))
    several = spans.where("duration_ns > 0").select("pid", "tid").distinct().count() > 1
    if not several:
        return tree.select("path", "depth", "category", "total_ns", "count")
    heads = tree.where("depth = 0").groupBy("pid", "tid").agg(F.sum("total_ns").alias("total_ns"), F.sum("count").alias("count"))
    heads = heads.select(F.array(root).alias("path"), F.lit(0).alias("depth"), F.lit("other").alias("category"), "total_ns", "count")
    return heads.unionByName(tree.select(F.concat(F.array(root), "path").alias("path"), (F.col("depth") + 1).alias("depth"), "category", "total_ns", "count"))
