"""MinHash near-dedup by an LSH forest.

Every text becomes the set of its distinct five-word shingles and a MinHash
signature of ``TREES * DEPTH`` slots.  Tree t sorts all texts by its own
``DEPTH`` slots; neighbours in that order share the longest prefixes, and those
whose common prefix is deep enough for their region are candidates.  The depth
asked for adapts, from ``LEAST_DEPTH`` to ``MOST_DEPTH``: where more than
``REGION`` texts share a prefix, a longer one is asked for.  Candidates are
confirmed on full shingle sets.  Texts that share ``MOST_DEPTH`` slots with more
others than the window holds are joined exactly, by a prefix filter (``crossing``).

Recall is audited in every run: about ``AUDIT`` texts (chosen by hash) are compared with
all others by their full sets.  Links that the forest lacks join the result, and the share
of those it had is returned; below ``LEAST_RECALL`` there is no result but an error.

Scale: texts with equal sets are folded into one representative before any
comparison, so a group of copies costs one row.  The sorted orders are range
partitioned (a dense region spreads over tasks), each text meets at most
``WINDOW`` successors in each tree, and confirmed links are needed only until a
group hangs together: pairs that are already connected are not compared again.
Sets are compared within the JVM, two at a time, so that long texts need no large batches.

Defined results: null or blank texts have an empty set and link with nothing;
texts below five words have one shingle; rows that share an id give one row,
which links what any of them links, with the larger set's size; rows without an
id take no part; an empty table gives no rows; extra columns are ignored, whatever
their names.  Texts count as equal if number, sum and mixed sum of their 64-bit shingle hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import components, fixed_binary, materialize, partitions, release, slices, spread, table, utf8

WORDS, THRESHOLD = 5, 0.75
TREES, DEPTH, WINDOW, REGION, LEAST_DEPTH, MOST_DEPTH, BLOCK, LOADS = 16, 8, 2, 16, 1, 3, 256, 17
AUDIT, AUDIT_SHINGLES, LEAST_RECALL = 64, 1 << 20, 0.9
_A, _B = K.stream(11, TREES * DEPTH) | np.uint64(1), K.stream(12, TREES * DEPTH)
SETS = "doc_id long, hashes array<long>"
_BITS = np.uint8([bin(i).count("1") for i in range(256)])


def signature(s: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least permuted hash in each slot."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            part = s[i : i + 1024, None] * _A + _B
            part ^= part >> np.uint64(31)
            least = np.minimum(least, part.min(axis=0))
        return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(">u2")


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "fp_a", "fp_b", "sig"]
    for batch in batches:
        data, offs = utf8(batch.column(1))
        for i, j in slices(offs):
            h, at = K.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            x, _, start = K.shingles(h, at, n)
            count, fp = np.zeros(j - i, np.int64), np.zeros((2, j - i), np.uint64)
            sigs = np.zeros((j - i, TREES * DEPTH), ">u2")
            with np.errstate(over="ignore"):
                for d in np.flatnonzero(np.diff(start)):
                    s = np.unique(x[start[d] : start[d + 1]])
                    count[d] = len(s)
                    fp[0, d], fp[1, d] = s.sum(), K.mix(s).sum()
                    sigs[d] = signature(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(count), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), fixed_binary(sigs)], names
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The sorted shingle hashes of each text."""
    for batch in batches:
        data, offs = utf8(batch.column(1))
        for i, j in slices(offs):
            h, at = K.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            x, _, start = K.shingles(h, at, n)
            each = [np.unique(x[a:b]) for a, b in zip(start[:-1], start[1:])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32)
            values = np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "hashes"])


def _audited(batches: Iterator[pa.RecordBatch], shared, n: int, per_cent: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """All links (a, b) of the audited texts a, by comparing full sets."""
    ids, sizes, known, begin, owner = shared.value
    look = K.Lookup(known)
    for batch in batches:
        own = np.asarray(batch.column(0))
        data, offs = utf8(batch.column(1))
        for i, j in slices(offs):
            h, at = K.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            x, of, start = K.shingles(h, at, n)
            pos, k = look.find(x)
            if not len(pos):
                continue
            pair = np.unique(of[pos] * len(known) + k)  # each shingle of a text once
            doc, k = pair // len(known), pair % len(known)
            many = begin[k + 1] - begin[k]
            entry = np.arange(many.sum()) + np.repeat(begin[k] - (np.cumsum(many) - many), many)
            key, both = np.unique(np.repeat(doc, many) * len(ids) + owner[entry], return_counts=True)
            doc, who = key // len(ids), key % len(ids)
            size = {d: len(np.unique(x[start[d] : start[d + 1]])) for d in np.unique(doc).tolist()}
            union = sizes[who] + np.array([size[d] for d in doc.tolist()], np.int64) - both
            good = (100 * both >= per_cent * union) & (ids[who] != own[i + doc])
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[good]]), pa.array(own[i + doc[good]])], ["a", "b"])


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tree: its slots as the sort key, and one bit of every slot as a sketch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, TREES, DEPTH)
        bits = np.packbits((sig.reshape(n, -1) & 1).astype(np.uint8), axis=1)
        key = np.ascontiguousarray(sig.transpose(1, 0, 2)).reshape(TREES * n, DEPTH)
        tree = np.repeat(np.arange(TREES, dtype=np.int32), n)
        ids = np.tile(np.asarray(batch.column(0)), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(tree), fixed_binary(key), pa.array(ids), fixed_binary(np.tile(bits, (TREES, 1)))], ["tree", "key", "doc_id", "bits"])


def adaptive_depth(lcp: np.ndarray) -> np.ndarray:
    """For every row of a sorted order (lcp[i]: shared slots of rows i and i+1), the prefix depth its region asks for."""
    n = len(lcp) + 1
    depth = np.full(n, LEAST_DEPTH, np.int64)
    for d in range(LEAST_DEPTH, MOST_DEPTH):
        edge = np.flatnonzero(lcp < d)
        start = np.concatenate([[0], edge + 1])
        size = np.diff(np.append(start, n))
        crowded = np.repeat(size > REGION, size)
        if not crowded.any():
            break
        depth[crowded] = d + 1
    return depth


def _neighbours(batches: Iterator[pa.RecordBatch], least_bits: float) -> Iterator[pa.RecordBatch]:
    """Candidates among sorted rows, the same however the rows come in batches.

    What is asked of a row depends on the ``REGION`` rows on either side, so a row waits
    until those behind it have come, and those before it are kept.

    A text that shares ``MOST_DEPTH`` slots with more texts than it can meet here,
    or that lies at a partition's edge, is given as a pair with itself: it is crowded.
    """
    width, wait = TREES * DEPTH, WINDOW + REGION

    def found(rows: tuple, lo: int, hi: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of rows lo to hi - 1 with those behind them, and the crowded ones of them."""
        tree, key, ids, bits = rows
        same = (key[:-1] == key[1:]) & (tree[:-1] == tree[1:])[:, None]
        lcp = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
        depth = adaptive_depth(lcp)
        start = np.concatenate([[0], np.flatnonzero(lcp < MOST_DEPTH) + 1])
        size = np.diff(np.append(start, len(ids)))
        many = size > WINDOW + 1
        many[0] |= first
        many[-1] |= last
        crowded = np.unique(ids[lo:hi][np.repeat(many, size)[lo:hi]])
        a_, b_, agree_ = [crowded], [crowded], [np.zeros(len(crowded))]
        shared = lcp
        for step in range(1, WINDOW + 1):
            if step > 1:
                shared = np.minimum(shared[:-1], lcp[step - 1 :])
            if not len(shared):
                break
            a = np.flatnonzero(shared[lo:hi] >= np.minimum(depth[:-step], depth[step:])[lo:hi]) + lo
            agree = 1 - _BITS[bits[a] ^ bits[a + step]].sum(axis=1) / width
            a, agree = a[agree >= least_bits], agree[agree >= least_bits]
            a_.append(np.minimum(ids[a], ids[a + step]))
            b_.append(np.maximum(ids[a], ids[a + step]))
            agree_.append(agree)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_, b_, agree_)], ["a", "b", "agree"])

    held, done, first = None, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        now = (
            np.asarray(batch.column(0)),
            np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, DEPTH),
            np.asarray(batch.column(2)),
            np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, width // 8),
        )
        held = now if held is None else tuple(np.concatenate([a, b]) for a, b in zip(held, now))
        ready = len(held[0]) - wait
        if ready > done:
            yield from found(held, done, ready, first, False)
            keep = max(0, ready - REGION)
            held, done, first = tuple(x[keep:] for x in held), ready - keep, first and keep == 0
    if held is not None:
        yield from found(held, done, len(held[0]), first, True)


def links_of(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar enough."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"), F.size("hashes").alias("nx"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"), F.size("hashes").alias("ny"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").where(f"100 * least(nx, ny) >= {per_cent} * greatest(nx, ny)")
    both = both.select("a", "b", "nx", "ny", F.size(F.array_intersect("x", "y")).alias("k"))
    return both.where(f"100 * k >= {per_cent} * (nx + ny - k)").select("a", "b")


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each of ``2 ** LOADS`` cells of hashes."""
    total = np.zeros(1 << LOADS, np.int64)
    for batch in batches:
        h = np.asarray(batch.column(0).flatten()).view(np.uint64)
        total += np.bincount((h >> np.uint64(64 - LOADS)).astype(np.int64), minlength=1 << LOADS)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["load", "n"])


def prefix_lengths(n: int, per_cent: int) -> tuple[int, int]:
    """How many of its first shingles, in one order for all texts, a text of ``n`` must share one of with a partner that is no larger, and with one no smaller."""
    return n + 1 + (-per_cent * n) // 100, n + 1 + (-2 * per_cent * n) // (100 + per_cent)


def _prefixes(batches: Iterator[pa.RecordBatch], shared, per_cent: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The first shingles of each text, those of the emptiest cells first."""
    load = shared.value
    for batch in batches:
        token, at, size, long_ = [], [], [], []
        for x in batch.column(2):
            h = np.asarray(x.values).view(np.uint64)
            probe, _ = prefix_lengths(len(h), per_cent)
            token.append(h[np.lexsort((h, load[h >> np.uint64(64 - LOADS)]))[:probe]].view(np.int64))
            at.append(np.arange(probe, dtype=np.int32))
            size.append(len(h))
            long_.append(probe)
        if token:
            row = np.repeat(np.arange(batch.num_rows), long_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(token)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.repeat(np.int32(size), long_)), pa.array(np.concatenate(at))],
                ["token", "doc_id", "comp", "n", "pos"],
            )


def crossing(label: DataFrame, crowded: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """All pairs (a, b) of crowded texts of different components that may link, by an exact prefix filter.

    In a crowded region a text meets only some of the others, so what it missed is
    looked for here: two texts that link share one of their rarest shingles.
    Shingles that only one component has are left out; a shingle of many texts is
    dealt to blocks.
    """
    spark = sets.sparkSession
    mine = crowded.join(sets, "doc_id")
    counts = mine.select("hashes").mapInArrow(_loads, "load int, n long").groupBy("load").agg(F.sum("n").alias("n")).toPandas()
    load = np.zeros(1 << LOADS, np.int64)
    load[counts["load"].to_numpy(np.int64)] = counts["n"]
    shared = spark.sparkContext.broadcast(load)
    mine = mine.join(label.select(F.col("id").alias("doc_id"), F.col("component_id").alias("comp")), "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), "hashes")
    rows = materialize(mine.mapInArrow(lambda it: _prefixes(it, shared, per_cent), "token long, doc_id long, comp long, n int, pos int"), "mh-prefix")
    shared.destroy()
    many = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("cells"))
    rows = rows.join(many, "token").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    x = rows.select("token", F.col("mine").alias("i"), F.col("theirs").alias("j"), F.col("doc_id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    y = rows.where(f"pos <= n - ceil({2 * per_cent} * n / {100 + per_cent})")
    y = y.select("token", F.col("theirs").alias("i"), F.col("mine").alias("j"), F.col("doc_id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    met = x.join(y, ["token", "i", "j"]).where("cx <> cy and (ny < nx or (ny = nx and y < x))")
    # what follows the shared shingle must suffice, in both
    met = met.where(f"100 * ny >= {per_cent} * nx and {100 + per_cent} * least(nx - px, ny - py) >= {per_cent} * (nx + ny)")
    pairs = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "mh-crossing")
    release(rows)
    return pairs


def between(pairs: DataFrame, links: DataFrame, label: DataFrame) -> DataFrame:
    """Candidates that cross from one component to another, also against the other one's hub: the text with the most links, from which its members were likely made."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).join(label, "id")
    hub = degree.groupBy("component_id").agg(F.max(F.struct("n", (-F.col("id")).alias("id"))).alias("m")).select("component_id", (-F.col("m.id")).alias("hub"))
    own = label.join(hub, "component_id")
    la = own.select(F.col("id").alias("a"), F.col("component_id").alias("ca"), F.col("hub").alias("ha"))
    lb = own.select(F.col("id").alias("b"), F.col("component_id").alias("cb"), F.col("hub").alias("hb"))
    rest = pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", F.coalesce("ha", "a").alias("ha"), F.coalesce("hb", "b").alias("hb"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # a text that has no links, or is a hub, is its own: its pairs are given once, not three times
    return rest.select(F.explode(F.array_distinct(F.array(pair("a", "b"), pair("a", "hb"), pair("ha", "b")))).alias("p")).select("p.a", "p.b").distinct()


def audit(texts: DataFrame, sketch: DataFrame, reps: DataFrame, words: int, per_cent: int) -> DataFrame:
    """All links (a, b) between about ``AUDIT`` representatives, chosen by hash, and any representative."""
    spark = texts.sparkSession
    few = max(1, reps.count() // AUDIT)
    own = reps.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(few)) == 0)
    size = sketch.select("doc_id", "n_shingles").join(own, "doc_id").groupBy("doc_id").agg(F.max("n_shingles").alias("n")).orderBy(F.xxhash64("doc_id")).limit(4 * AUDIT).collect()
    chosen, total = [], 0
    for r in size:  # a bounded number of texts with a bounded number of shingles in all, but one text at least
        if total + r.n <= AUDIT_SHINGLES or not chosen:
            chosen.append(r.doc_id)
            total += r.n
    rows = texts.where(F.col("doc_id").isin(chosen)).mapInArrow(lambda it: _sets(it, words), SETS).where("size(hashes) > 0").collect()
    ids = np.array([r.doc_id for r in rows], np.int64)
    each = [np.array(r.hashes, np.int64).view(np.uint64) for r in rows]
    every = np.concatenate([*each, np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    known, begin = np.unique(every[order], return_index=True)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in each])[order]
    shared = spark.sparkContext.broadcast((ids, np.array([len(x) for x in each], np.int64), known, np.append(begin, len(every)), owner))
    found = texts.mapInArrow(lambda it: _audited(it, shared, words, per_cent), "a long, b long")
    out = materialize(found.join(reps.withColumnRenamed("doc_id", "b"), "b", "left_semi").where("a <> b").distinct(), "mh-truth")
    shared.destroy()
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, audit_recall for every distinct doc_id of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    per_cent = round(100 * threshold)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = texts.mapInArrow(lambda it: _sketches(it, words), "doc_id long, n_shingles long, fp_a long, fp_b long, sig binary")
    sketch = materialize(sketch, "mh-sketch")
    full = sketch.where("n_shingles > 0")
    # the signature comes along: equal sets have equal ones
    signed = materialize(full.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select("fp_a", "fp_b", "n_shingles", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig")), "mh-classes")
    classes = signed.drop("sig")
    rows = signed.select(F.col("rep").alias("doc_id"), "sig").mapInArrow(_tree_rows, "tree int, key binary, doc_id long, bits binary")
    n = max(partitions(spark), 2 * TREES)
    # equal keys in another order in each tree, so that what sorts next to them meets other ones of them each time
    order = ("tree", "key", F.xxhash64("doc_id", "tree"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # a bit of a slot agrees by chance half of the time; four standard deviations below the threshold
    share = threshold + (1 - threshold) / 2
    least = share - 4 * (share * (1 - share) / (TREES * DEPTH)) ** 0.5
    pairs = rows.mapInArrow(lambda it: _neighbours(it, least), "a long, b long, agree double")
    written = materialize(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), "mh-pairs")
    pairs, crowded = written.where("a <> b"), written.where("a = b").select(F.col("a").alias("doc_id"))
    involved = written.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # dealt by id once: long texts, and the work on their sets, spread evenly
    sets = spread(texts, "doc_id").join(involved, "doc_id").mapInArrow(lambda it: _sets(it, words), SETS)
    sets = materialize(sets, "mh-sets")
    confirmed = lambda some, name: materialize(links_of(some, sets, per_cent), name)

    # First every text's likeliest partner, then whatever still crosses from one group to another.
    either = pairs.select("a", "b", "agree", F.col("a").alias("me")).union(pairs.select("a", "b", "agree", F.col("b").alias("me")))
    best = either.groupBy("me").agg(F.max(F.struct("agree", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    tried = materialize(best, "mh-tried")
    links = confirmed(tried, "mh-links")
    while True:
        label = materialize(components(links, "mh-cc"), "mh-label")
        rest = materialize(between(pairs, links, label).join(tried, ["a", "b"], "left_anti"), "mh-rest")
        more = confirmed(rest, "mh-more")
        if more.limit(1).count() == 0:
            break
        links, tried = links.union(more), tried.union(rest)
    # what the windows left out, in full
    links = links.union(confirmed(crossing(label, crowded, sets, per_cent), "mh-found"))
    label = materialize(components(links, "mh-cc2"), "mh-label2")
    truth = audit(texts, sketch, classes.select(F.col("rep").alias("doc_id")).distinct(), words, per_cent)
    la, lb = (label.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}")) for c in "ab")
    missed = truth.join(la, "a", "left").join(lb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    wanted, lost = truth.count(), missed.count()
    recall = 1.0 - lost / wanted if wanted else 1.0
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the forest found only {recall:.3f} of the audited links")
    if lost:
        label = materialize(components(links.union(missed), "mh-cc3"), "mh-label3")
    release(truth)
    label = label.select(F.col("id").alias("rep"), F.col("component_id").alias("cid"))
    by_class = materialize(classes.join(label, "rep", "left").select("fp_a", "fp_b", "n_shingles", F.coalesce("cid", "rep").alias("cid")), "mh-class-label")
    out = sketch.select("doc_id", "n_shingles", "fp_a", "fp_b").join(by_class, ["fp_a", "fp_b", "n_shingles"], "left")
    release(written)
    release(sets)
    out = out.select("doc_id", "n_shingles", F.coalesce("cid", "doc_id").alias("component_id"))
    return out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id")).withColumn("audit_recall", F.lit(recall))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the smallest doc_id; rows without one stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept, CAST(1 AS DOUBLE) AS audit_recall
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
