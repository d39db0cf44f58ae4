"""Near-duplicate vectors by NN-descent.

A neighbour graph is started from blocks of vectors that lie together in
orders sorted by random projections, then refined: each round, every vector
looks among the neighbours (and those that name it) of its neighbours, and
keeps its ``K`` most similar; only what is nearer than the last of a list is
handed on.  A vector takes part in the neighbourhoods of at most ``HUB * K`` of those that
name it in a round (chosen by hash anew each time), so a hub costs no more than that.
Threshold edges join vectors into components.

A vector whose whole list reaches the threshold is saturated: its list may hide
links, so saturated vectors of different components are compared in full where
their cells are near enough (``hidden_links``), and the members of the component
are counted rather than listed.
Around a component's mean direction, members within half the threshold angle
of it are linked with one another by the triangle inequality, so they need no
comparison; the others are compared in blocks.  No pair of a group is ever
emitted, whatever the group's size.

Recall is audited: ``AUDIT`` vectors (chosen by hash) are compared with all
others; while they have links that the graph lacks, another round follows, with
longer lists.  The links the audit finds join the graph as well, and the share that the
graph had by itself is returned; below ``LEAST_RECALL`` there is no result but an error.

Similarities are in single precision while searching and in double precision
where they decide.  Equal directions are folded into one row first.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length don't link; equal
vectors link; rows that share a vec_id are one vector (the first by content); rows
without a vec_id take no part and give no row; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, partitions, release, table, utf8

THRESHOLD, K, TREES, BLOCK, ROUNDS, AUDIT, GROUP = 0.95, 12, 6, 256, 2, 256, 512
MORE_ROUNDS, LEAST_RECALL, HUB, DEAL = 5, 0.9, 16, 16
EDGES = "u long, v long, s float"


def unit(x: np.ndarray) -> np.ndarray | None:
    """The direction of a vector in double precision; None if it has none."""
    if x.size == 0 or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, half, dims = [], [], []
        for v in batch.column(1):
            x = None
            if v.is_valid and not v.values.null_count:
                x = unit(np.asarray(v.values, dtype=np.float64))
            out.append(None if x is None else x.tobytes())
            half.append(None if x is None else x.astype(np.float32).tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(half, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "x", "x32", "dim"])


def matrix(col: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of binary vectors of one length and kind."""
    raw, offs = utf8(col)
    n = len(offs) - 1
    return np.frombuffer(raw.tobytes(), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _projected(batches: Iterator[pa.RecordBatch], bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For each tree a sort key: the signs along ``bits`` random directions, then the place along another one."""
    for batch in batches:
        dims = np.asarray(batch.column(2))
        for dim in np.unique(dims):
            some = batch.take(pa.array(np.flatnonzero(dims == dim)))
            x = matrix(some.column(1), np.float32)
            planes = np.random.default_rng([seed, int(dim)]).standard_normal((TREES, bits + 1, int(dim))).astype(np.float32)
            for t in range(TREES):
                y = x @ planes[t].T
                code = (y[:, :bits] > 0) @ (1 << np.arange(bits)[::-1])
                code = code ^ (code >> 1) if bits > 1 else code
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(y[:, bits].astype(np.float64)), some.column(0), some.column(1), some.column(2)],
                    ["tree", "code", "place", "vec_id", "x", "dim"],
                )


def best_in_block(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a block its ``k`` most similar others."""
    n = len(ids)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel().astype(np.float32)


def _block_edges(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that follow one another in a sorted order."""
    held: pa.Table | None = None

    def edges(t: pa.Table) -> pa.RecordBatch:
        part = [c.combine_chunks() for c in t.columns]
        tree, dim, ids = np.asarray(part[0]), np.asarray(part[5]), np.asarray(part[3])
        out = []
        for key in np.unique(tree.astype(np.int64) << 32 | dim):
            rows = np.flatnonzero((tree.astype(np.int64) << 32 | dim) == key)
            out.append(best_in_block(ids[rows], matrix(part[4].take(pa.array(rows)), np.float32), k))
        u, v, s = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "s"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        while held.num_rows >= 2 * BLOCK:
            yield edges(held.slice(0, BLOCK))
            held = held.slice(BLOCK)
    if held is not None and held.num_rows > 1:
        yield edges(held)


def _local_join(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Members of each neighbourhood against one another: each keeps its ``k`` best, if they are nearer than the last of its list."""
    for batch in batches:
        found = []
        for group in batch.column(0):
            members = group.values
            ids = np.asarray(members.field("m"))
            u, v, s = best_in_block(ids, matrix(members.field("x"), np.float32), k)
            near = s > np.repeat(np.asarray(members.field("low")), min(k, len(ids) - 1))
            found.append((u[near], v[near], s[near]))
        if found:
            u, v, s = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((v, -s, u))
            u, v, s = u[order], v[order], s[order]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])  # equal pairs have equal similarities and lie together
            u, v, s = u[new], v[new], s[new]
            begin = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
            rank = np.arange(len(u)) - np.repeat(begin, np.diff(np.append(begin, len(u))))
            yield pa.RecordBatch.from_arrays([pa.array(c[rank < k]) for c in (u, v, s)], ["u", "v", "s"])


def top_lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar neighbours of each vector (it is in a bounded number of blocks or neighbourhoods, which give ``k`` each)."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    best = one.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "v")), asc=False), 1, k).alias("l"))
    return best.select("u", F.explode("l").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"))


def descend(graph: DataFrame, vectors: DataFrame, k: int, round_: int) -> DataFrame:
    """One round: candidates among neighbours and reverse neighbours that share a neighbour."""
    named = graph.select("u", "v", F.xxhash64("u", "v", F.lit(round_)).alias("h"))
    forward = _sampled(named, "v", "u", HUB * k).select(F.col("u").alias("c"), F.col("v").alias("m"))
    back = _sampled(named, "v", "u", k).select(F.col("v").alias("c"), F.col("u").alias("m"))
    own = graph.select(F.col("u").alias("c"), F.col("u").alias("m"))
    member = forward.union(back).union(own).distinct()
    low = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("low"))
    known = vectors.select(F.col("vec_id").alias("m"), F.col("x32").alias("x"), "dim").join(low.withColumnRenamed("u", "m"), "m")
    member = member.join(known, "m")
    groups = member.groupBy("c", "dim").agg(F.collect_list(F.struct("m", "x", "low")).alias("g")).where(F.size("g") > 1).select("g")
    found = groups.mapInArrow(lambda it: _local_join(it, k), EDGES)
    return top_lists(graph.union(found), k)


def _sampled(rows: DataFrame, by: str, other: str, n: int) -> DataFrame:
    """At most ``n`` rows of each ``by``, spread by their hash h, with partial aggregation: one of each of ``n`` hash cells."""
    cell = rows.groupBy(by, F.pmod("h", F.lit(n)).alias("cell")).agg(F.min(F.struct("h", other)).alias("r"))
    return cell.select(by, F.col(f"r.{other}").alias(other))


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cos = [np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64) for x, y in zip(batch.column(2), batch.column(3))]
        good = pa.array(np.flatnonzero(np.array(cos) >= threshold))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["a", "b"])


def confirmed(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose cosine in double precision reaches the threshold."""
    x = vectors.select(F.col("vec_id").alias("a"), F.col("x"), F.col("dim").alias("da"))
    y = vectors.select(F.col("vec_id").alias("b"), F.col("x").alias("y"), F.col("dim").alias("db"))
    both = pairs.select("a", "b").distinct().join(x, "a").join(y, "b").where("da = db")
    return both.select("a", "b", "x", "y").mapInArrow(lambda it: _exact(it, threshold), "a long, b long")


def _audit(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Links of the audited vectors with all rows, by brute force."""
    queries = shared.value
    for batch in batches:
        ids, dims = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        for dim, (qid, q) in queries.items():
            rows = np.flatnonzero(dims == dim)
            if len(rows):
                s = q @ matrix(batch.column(1).take(pa.array(rows))).T
                a, b = np.nonzero(s >= threshold)
                a, b = qid[a], ids[rows][b]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


# ------------------------------------------------------------------ links that full lists hide


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean direction of each cell and the largest angle of a member to it."""
    for batch in batches:
        mean, radius = [], []
        for group in batch.column(3):
            x = matrix(group.values.field("x"))
            m = unit(x.sum(axis=0))
            mean.append((x[0] if m is None else m).tobytes())
            radius.append(np.pi if m is None else float(np.arccos(np.clip(x @ m, -1, 1)).max()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean, pa.binary()), pa.array(radius, pa.float64())], ["comp", "dim", "cell", "g", "mean", "radius"])


def _near_balls(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of cells of different components that are near enough, by the triangle inequality, to hold a link."""
    reach = float(np.arccos(threshold)) + 1e-6
    for batch in batches:
        one, two = [], []
        for f, g in zip(batch.column(0), batch.column(1)):
            f, g = f.values, g.values
            angle = np.arccos(np.clip(matrix(f.field("mean")) @ matrix(g.field("mean")).T, -1, 1))
            near = angle <= np.asarray(f.field("radius"))[:, None] + np.asarray(g.field("radius"))[None, :] + reach
            near &= np.asarray(f.field("comp"))[:, None] < np.asarray(g.field("comp"))[None, :]
            a, b = np.nonzero(near)
            one.append(np.asarray(f.field("ball"))[a])
            two.append(np.asarray(g.field("ball"))[b])
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], ["one", "two"])


def _one_link(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """A link of each two cells, if they have any: one joins their components."""
    for batch in batches:
        a, b = [], []
        for f, g in zip(batch.column(0), batch.column(1)):
            f, g = f.values, g.values
            s = matrix(f.field("x")) @ matrix(g.field("x")).T
            i, j = np.unravel_index(s.argmax(), s.shape)
            if s[i, j] >= threshold:
                u, v = f.field("vec_id")[int(i)].as_py(), g.field("vec_id")[int(j)].as_py()
                a.append(min(u, v)), b.append(max(u, v))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def hidden_links(graph: DataFrame, label: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """Links (a, b) between components whose members' lists are full of nearer neighbours.

    A link that neither list holds is one of two saturated vectors, so only these
    are compared: in cells of a component, those near enough to another's.
    """
    n = partitions(vectors.sparkSession)
    full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("s")).where((F.col("n") >= k) & (F.col("s") >= threshold - 1e-4)).select(F.col("u").alias("vec_id"))
    full = full.join(label.select(F.col("id").alias("vec_id"), F.col("component_id").alias("comp")), "vec_id").select("comp", "vec_id")
    size = full.groupBy("comp").agg(F.count("*").alias("size"))
    full = dealt(full, size).join(vectors.select("vec_id", "x", "dim"), "vec_id")
    cell = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.ceil(F.col("size") / GROUP).cast("long"))
    cells = full.groupBy("comp", "dim", cell.alias("cell")).agg(F.collect_list(F.struct("vec_id", "x")).alias("g"))
    balls = cells.mapInArrow(_balls, "comp long, dim int, cell long, g array<struct<vec_id:long,x:binary>>, mean binary, radius double")
    balls = materialize(balls.withColumn("ball", F.xxhash64("comp", "cell")), "nn-balls")
    deal = max(1, -(-balls.count() // GROUP))
    row = F.collect_list(F.struct("ball", "comp", "mean", "radius"))
    blocks = balls.groupBy("dim", F.pmod(F.xxhash64("ball", F.lit(4)), F.lit(deal)).alias("block"))
    one = blocks.agg(row.alias("f")).select("dim", "f", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("block"))
    met = one.join(blocks.agg(row.alias("h")), ["dim", "block"]).select("f", "h").repartition(n)
    near = materialize(met.mapInArrow(lambda it: _near_balls(it, threshold), "one long, two long"), "nn-near")
    one, two = balls.select(F.col("ball").alias("one"), F.col("g").alias("f")), balls.select(F.col("ball").alias("two"), F.col("g").alias("h"))
    both = near.join(one, "one").join(two, "two").select("f", "h").repartition(n)
    return materialize(both.mapInArrow(lambda it: _one_link(it, threshold), "a long, b long"), "nn-hidden")


# ------------------------------------------------------------------ counting links within components


def _count_small(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each member of components of at most ``GROUP`` members."""
    for batch in batches:
        out_id, out_n = [], []
        for group in batch.column(0):
            m = group.values
            ids, x, w = np.asarray(m.field("vec_id")), matrix(m.field("x")), np.asarray(m.field("copies"))
            near = (x @ x.T) >= threshold
            np.fill_diagonal(near, True)
            out_id.append(ids)
            out_n.append(near @ w - 1)
        if out_id:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n).astype(np.int64))], ["vec_id", "n_links"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the members' directions of each component within a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        comp, x = np.asarray(batch.column(0)), matrix(batch.column(1))
        for c in np.unique(comp):
            total[int(c)] = total.get(int(c), 0) + x[comp == c].sum(axis=0)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["comp", "sum"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Angle of each member to its component's mean direction."""
    for batch in batches:
        angle = []
        for x, mean in zip(batch.column(2), batch.column(3)):
            m = unit(np.asarray(mean.values))
            v = np.frombuffer(x.as_buffer(), np.float64)
            angle.append(np.pi if m is None else float(np.arccos(np.clip(v @ m, -1, 1))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(angle), batch.column(4)], ["comp", "vec_id", "x", "angle", "copies"])


def _count_blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of the members of one block outside the cap with those of another block."""
    for batch in batches:
        ids_out, n_out = [], []
        for one, two in zip(batch.column(0), batch.column(1)):
            a, b = one.values, two.values
            x, y, w = matrix(a.field("x")), matrix(b.field("x")), np.asarray(b.field("copies"))
            ids, other = np.asarray(a.field("vec_id")), np.asarray(b.field("vec_id"))
            near = (x @ y.T) >= threshold
            same = ids[:, None] == other[None, :]
            in_cap = np.asarray(b.field("cap"))
            ids_out.append(ids)
            n_out.append((near & ~same) @ w)
            # members of the cap gain the links with this block's rows
            ids_out.append(other[in_cap])
            n_out.append((near[:, in_cap] & ~same[:, in_cap]).T @ np.asarray(a.field("copies")))
        if ids_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids_out)), pa.array(np.concatenate(n_out).astype(np.int64))], ["vec_id", "n"])


def dealt(rows: DataFrame, by_component: DataFrame) -> DataFrame:
    """``rows`` (comp, vec_id) with the columns of their component, of which there are ``DEAL`` copies: a large component spreads over tasks."""
    copies = by_component.withColumn("deal_", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    own = rows.withColumn("deal_", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(DEAL)).cast("int"))
    return own.join(copies, ["comp", "deal_"]).drop("deal_")


def count_links(label: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """vec_id, n_links of all labelled vectors (comp, vec_id), copies of a vector counted with it."""
    n = partitions(vectors.sparkSession)
    size = label.groupBy("comp").agg(F.count("*").alias("size"))
    sized = dealt(label, size).join(vectors.select("vec_id", "x", "copies"), "vec_id")  # sizes first: vectors move by their own ids only
    small = sized.where(F.col("size") <= GROUP).groupBy("comp").agg(F.collect_list(F.struct("vec_id", "x", "copies")).alias("g")).select("g")
    out = small.mapInArrow(lambda it: _count_small(it, threshold), "vec_id long, n_links long")
    large = sized.where(F.col("size") > GROUP).select("comp", "vec_id", "x", "copies", "size")
    sums = large.select("comp", "x").mapInArrow(_sums, "comp long, sum array<double>").select("comp", F.posexplode("sum").alias("i", "s"))
    means = sums.groupBy("comp", "i").agg(F.sum("s").alias("s")).groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("mean"))
    angled = dealt(large, means).select("comp", "vec_id", "x", "mean", "copies")
    angled = materialize(angled.mapInArrow(_angles, "comp long, vec_id long, x binary, angle double, copies long"), "nn-angles")
    half = float(np.arccos(threshold)) / 2 - 1e-9
    angled = angled.withColumn("cap", F.col("angle") <= half)
    inside = angled.where("cap").groupBy("comp").agg(F.sum("copies").alias("all"))
    capped = dealt(angled.where("cap"), inside).select("vec_id", (F.col("all") - 1).alias("n"))
    # the rest, in blocks of GROUP, against all blocks of their component, each two of them by a key of their own
    cells = F.ceil(F.col("size") / GROUP).cast("long")
    cell = lambda name, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), cells).alias(name)
    withsize = dealt(angled, size.where(F.col("size") > GROUP))
    row = F.struct("vec_id", "x", "copies", "cap")
    blocks = withsize.groupBy("comp", cell("cell", 1)).agg(F.collect_list(row).alias("g"))
    edge = withsize.where("not cap").groupBy("comp", "size", cell("mine", 2)).agg(F.collect_list(row).alias("f"))
    met = edge.select("comp", "f", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell")).join(blocks, ["comp", "cell"]).select("f", "g").repartition(n)
    fringe = met.mapInArrow(lambda it: _count_blocks(it, threshold), "vec_id long, n long")
    outside = angled.where("not cap").select("vec_id", (F.col("copies") - 1).alias("n"))
    total = capped.union(outside).union(fringe).groupBy("vec_id").agg(F.sum("n").cast("long").alias("n_links"))
    return out.unionByName(total)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for every vec_id of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    n = partitions(spark)
    raw = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    units = raw.mapInArrow(_units, "vec_id long, x binary, x32 binary, dim int").groupBy("vec_id").agg(F.min(F.struct("dim", "x", "x32")).alias("v"))
    units = materialize(units.select("vec_id", "v.x", "v.x32", "v.dim"), "nn-units")
    valid = units.where("dim > 0")
    # equal directions: one representative, that of the smallest id
    fold = valid.groupBy("dim", F.sha2("x", 256).alias("digest")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    fold = materialize(fold, "nn-fold")
    reps = valid.join(fold.select(F.col("rep").alias("vec_id"), "copies"), "vec_id")
    reps = materialize(reps.select("vec_id", "x", "x32", "dim", "copies"), "nn-reps")
    count = reps.count()
    bits = max(0, int(np.ceil(np.log2(max(1, count / BLOCK)))))
    started = reps.select("vec_id", F.col("x32").alias("x"), "dim").mapInArrow(lambda it: _projected(it, bits, 1), "tree int, code long, place double, vec_id long, x binary, dim int")
    started = started.repartitionByRange(max(n, TREES), "tree", "dim", "code", "place").sortWithinPartitions("tree", "dim", "code", "place")
    graph = materialize(top_lists(started.mapInArrow(lambda it: _block_edges(it, K), EDGES), K), "nn-graph")
    audited = reps.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, count // AUDIT))) == 0).limit(4 * AUDIT).collect()
    queries: dict[int, tuple] = {}
    for dim in {r.dim for r in audited}:
        some = [r for r in audited if r.dim == dim]
        queries[dim] = (np.array([r.vec_id for r in some], np.int64), np.array([np.frombuffer(r.x, np.float64) for r in some]))
    shared = spark.sparkContext.broadcast(queries)
    truth = materialize(reps.select("vec_id", "x", "dim").mapInArrow(lambda it: _audit(it, shared, threshold), "a long, b long"), "nn-truth")
    shared.destroy()
    wanted = truth.count()
    k, done = K, 0
    while True:
        rounds = ROUNDS if done == 0 else 1
        for _ in range(rounds):
            done += 1
            new = materialize(descend(graph, reps, k, done), "nn-graph")
            release(graph)
            graph = new
        close = graph.where(F.col("s") >= threshold - 1e-4).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        links = materialize(confirmed(close, reps, threshold), "nn-links")
        label = materialize(components(links, "nn-cc"), "nn-label")
        la, lb = label.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), label.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
        missed = truth.join(la, "a", "left").join(lb, "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
        lost = missed.count() if wanted else 0
        if not lost or done >= ROUNDS + MORE_ROUNDS:
            break
        k = 2 * k  # a longer list finds what a short one, full of nearer neighbours, couldn't hold
        release(links)
        release(label)
    recall = 1.0 - lost / wanted if wanted else 1.0
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the neighbour graph holds only {recall:.3f} of the audited links after {done} rounds")
    hidden = hidden_links(graph, label, reps, k, threshold)
    if lost or hidden.limit(1).count():
        links = links.union(hidden)
        label = materialize(components(links.union(missed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "nn-cc2"), "nn-label")
    members = label.select(F.col("component_id").alias("comp"), F.col("id").alias("vec_id"))
    counted = materialize(count_links(members, reps, threshold).join(label.withColumnRenamed("id", "vec_id"), "vec_id"), "nn-counts")
    by_class = fold.join(counted.select(F.col("vec_id").alias("rep"), "n_links", "component_id"), "rep", "left")
    by_class = by_class.select("dim", "digest", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = units.withColumn("digest", F.sha2("x", 256)).join(by_class, ["dim", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("audit_recall", F.lit(recall))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT link.b, r.c FROM r JOIN link ON link.a = r.a WHERE r.c < link.b),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept, CAST(1 AS DOUBLE) AS audit_recall
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id WHERE e.vec_id IS NOT NULL
"""
