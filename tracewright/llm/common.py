"""Shared plumbing of the training-data operators.

``materialize`` cuts lineage by writing Parquet into the folder that all
executors share (``spark.checkpoint.dir``), so that a lost executor never costs
more than its running tasks.  ``components`` labels the connected components of
an edge table without ever bringing edges to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import delete, scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: recomputation ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tw_path", None)
    if path is not None:
        delete(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash partition by ``keys``, as many parts as shuffles have here."""
    return df.repartition(partitions(df.sparkSession), *keys)


# --------------------------------------------------------------------------- Arrow helpers


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=width, count=len(col) + col.offset + 1)[col.offset :].astype(np.int64)
    if bufs[2] is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def binary_column(data: np.ndarray, offs: np.ndarray, kind=None) -> pa.Array:
    """A binary (or string) Arrow column over bytes and offsets."""
    return pa.Array.from_buffers(
        kind or pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    )


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offs = np.arange(len(rows) + 1, dtype=np.int64) * width
    return binary_column(np.frombuffer(rows.tobytes(), np.uint8), offs)


def slices(offs: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


# --------------------------------------------------------------------------- connected components

#: So many edges one task labels in an instant; the number doesn't grow with the input.
FEW = 1 << 14


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by a star forest with the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        keys = list(parent)
        roots = [find(k) for k in keys]
        pairs = [(r, k) for r, k in zip(roots, keys) if r != k]
        a = pa.array([p[0] for p in pairs], pa.int64())
        b = pa.array([p[1] for p in pairs], pa.int64())
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in (a, b):
                if x not in parent:
                    parent[x] = x
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 2_000_000:  # bounded memory: hand over the forest so far and begin anew
            yield flush()
            parent.clear()
    yield flush()


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vertex of few edges with the smallest id it is connected to."""
    for forest in _local_forest(batches):
        root, leaf = forest.columns
        top = root.unique()
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([leaf, top]), pa.concat_arrays([root, top])], ["id", "component_id"])


def components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Label vertices of ``edges`` (columns a, b: long) with the smallest id of their component.

    Each partition first shrinks its edges to a forest.  Then, in rounds, every
    vertex moves to its neighbour of least priority (a hash that changes from
    round to round, so that paths shrink geometrically); edges are relabelled,
    loops and repeats go.  A round is grouped aggregation and equi-joins: no vertex list is
    gathered in one task, and no edge reaches the driver.  Once at most ``FEW`` edges are left,
    however many there were, one task makes their forest.  Returns (id, component_id).
    """
    spark = edges.sparkSession
    live = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    live = materialize(live.mapInArrow(_local_forest, "a long, b long").distinct(), f"{name}-edges")
    whole = lambda: materialize(live.coalesce(1).mapInArrow(_least, "id long, component_id long"), f"{name}-whole")
    if live.count() <= FEW:
        label = whole()
        release(live)
        return label
    vertices = live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = materialize(vertices.select("id", F.col("id").alias("root")), f"{name}-label")
    for k in range(most_rounds):
        if live.count() <= FEW:
            rest = whole().select(F.col("id").alias("root"), F.col("component_id").alias("to"))
            label = label.join(rest, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
            break
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(k))
        move = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        move = move.select("a", F.when(F.struct(rank("a").alias("h"), F.col("a").alias("to")) <= F.col("m"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        move = materialize(move, f"{name}-move")
        one = move.select(F.col("a"), F.col("to").alias("na"))
        two = move.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        nxt = live.join(one, "a").join(two, "b")
        nxt = nxt.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct()
        nxt = materialize(nxt, f"{name}-edges")
        new = label.join(move.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        new = materialize(new, f"{name}-label")
        for old in (live, label, move):
            release(old)
        live, label = nxt, new
    else:
        raise RuntimeError("components did not settle")
    release(live)
    least = label.groupBy("root").agg(F.min("id").alias("component_id"))
    return label.join(least, "root").select("id", "component_id")
