"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

How many training documents hold each n-gram of the test items, for n from
``GRAM`` to ``LONGEST``, is counted over all documents.  The seed of a place in an item is the
shortest n-gram from there that is rare: at most ``RARE`` of all documents (or ``FEW`` of them,
in a small corpus) hold it; where none is, the longest.  Of each ``STRETCH`` neighbouring
places the rarest seed is kept, so seeds cover an item's whole length, however
often the item itself was copied, and short ones, which survive edits, are
used wherever they are rare enough.  Documents are then read once more: where seeds
hit, the passage around them is aligned with the item by Smith-Waterman over
words, which scores edited and paraphrased copies too.  A document leaks an item
if the alignment reaches ``THRESHOLD`` of the score of a verbatim copy.

Scale: texts are never shuffled.  Items travel to the executors in blocks of at
most ``BLOCK_BYTES`` (checked; a larger benchmark makes more blocks, each run
against all documents).  A common word pair of an item costs no alignments, as
it is lengthened until it is rare.  Hits are handled for as many documents at a time
as have about ``HITS`` of them.  An alignment is skipped only when the words that
passage and item share cannot reach the threshold.

Defined results: null and empty texts hold nothing; items without words match
nothing, items under two words match as whole sequences; equal item texts
all count; of equally good passages of a document the first counts; rows that
share a doc_id count as one document, with the best of their passages; rows
without an id take no part in ``leaks`` and stay in ``decontaminate``; empty tables
give no leaks; extra columns are ignored or stay, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import slices, table, utf8

GRAM, LONGEST, STRETCH, THRESHOLD = 2, 5, 2, 0.5
RARE, FEW, HITS = 0.001, 20, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 32 << 20
RESULT = "doc_id long, item_id long, score double, first_word int, last_word int"


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of all ``n``-grams; texts of fewer than ``GRAM`` words have themselves as the only one."""
    if n == GRAM:
        x, of, start = K.shingles(h, at, n)
        return x, of, at[:-1][of] + np.arange(len(x)) - start[:-1][of]
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(of[: len(h) - n + 1] == of[n - 1 :])
    return K.chain(h, n)[first], of[first], first


class Items:
    """The words and n-grams of a block of test items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, offs = utf8(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.h, self.at = K.word_hashes(data, offs)
        each = [grams(self.h, self.at, n) for n in range(GRAM, LONGEST + 1)]
        self.size = np.repeat(np.arange(GRAM, LONGEST + 1), [len(x) for x, _, _ in each])
        self.gram, self.of, self.first = (np.concatenate([x[c] for x in each]) for c in range(3))
        self.grams, self.which = np.unique(self.gram, return_inverse=True)

    def seeds(self, df: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted seed grams; for each, a run of (item, place) entries."""
        count = df[self.which]
        # of each place the shortest rare n-gram, else the longest
        order = np.lexsort((np.where(count <= bound, self.size, 2 * LONGEST - self.size), count > bound, self.first))
        own = order[np.unique(self.first[order], return_index=True)[1]]
        # of each stretch the rarest
        place = self.first[own] - self.at[self.of[own]]
        last = np.append(self.of[own][1:] != self.of[own][:-1], True)
        chosen = np.zeros(len(own), bool)
        begin = np.append(0, np.flatnonzero(last) + 1)
        for a, b in zip(begin[:-1], begin[1:]):
            for i in range(a, max(a + 1, b - STRETCH + 1)):
                chosen[i + int(np.argmin(count[own[i : min(b, i + STRETCH)]]))] = True
        own, place = own[chosen], place[chosen]
        order = np.argsort(self.gram[own], kind="stable")
        found, begin = np.unique(self.gram[own][order], return_index=True)
        return found, np.append(begin, len(order)), self.of[own][order], place[order]


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """How many documents hold each n-gram of the items, and (gram -1) how many there are."""
    known = K.Lookup(shared.value.grams)
    df, rows = np.zeros(len(known.known), np.int64), 0
    for batch in batches:
        data, offs = utf8(batch.column(1))
        rows += batch.num_rows
        for i, j in slices(offs):
            h, at = K.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            for n in range(GRAM, LONGEST + 1):
                x, of, _ = grams(h, at, n)
                pos, k = known.find(x)
                if len(pos):
                    df += np.bincount(np.unique(of[pos] * len(df) + k) % len(df), minlength=len(df))
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["gram", "df"])


def smith_waterman(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and where it begins and ends in ``x``."""
    row = np.zeros(len(x) + 1, np.int64)
    begin = np.arange(len(x) + 1)
    j = np.arange(len(x) + 1)
    best, lo, hi = 0, 0, 0
    for w in y:
        step = np.where(x == w, MATCH, MISMATCH)
        now, start = np.zeros_like(row), j.copy()
        diagonal, above = row[:-1] + step, row[1:] + GAP
        now[1:] = np.maximum(np.maximum(diagonal, above), 0)
        start[1:] = np.where(now[1:] == 0, j[1:], np.where(diagonal >= above, begin[:-1], begin[1:]))
        # gaps along x: a running maximum of score + distance
        run = np.maximum.accumulate(now - GAP * j)
        source = np.maximum.accumulate(np.where(now - GAP * j == run, j, 0))
        along = run + GAP * j
        better = along > now
        start = np.where(better, start[source], start)
        row, begin = np.maximum(now, along), start
        k = int(row.argmax())
        if row[k] > best:
            best, lo, hi = int(row[k]), int(begin[k]), k
    return best, lo, hi


def _align(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    items, (seeds, begin, of_item, place) = shared.value
    known = K.Lookup(seeds)
    length = np.diff(items.at)
    need = threshold * MATCH * length
    counted = [Counter(items.h[a:b].tolist()) for a, b in zip(items.at[:-1], items.at[1:])]

    def align(entry: np.ndarray, doc: np.ndarray, where: np.ndarray, h: np.ndarray, at: np.ndarray, best: dict) -> None:
        """Align the passages around hits (seed entry, document, word) with their items."""
        item = of_item[entry]
        origin = where - place[entry]  # where the item would begin
        order = np.lexsort((origin, item, doc))
        doc, item, origin = doc[order], item[order], origin[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > length[item[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        d, t = doc[first], item[first]
        slack = length[t] // 2 + 2
        lo = at[d] + np.maximum(0, origin[first] - slack)
        hi = np.minimum(at[d + 1], at[d] + origin[last] + length[t] + slack)
        for d_, t_, lo_, hi_ in zip(d.tolist(), t.tolist(), lo.tolist(), hi.tolist()):
            own = counted[t_]
            # words in common bound the score
            if MATCH * sum(map(own.__getitem__, own.keys() & set(h[lo_:hi_].tolist()))) < need[t_]:
                continue
            score, s, e = smith_waterman(h[lo_:hi_], items.h[items.at[t_] : items.at[t_ + 1]])
            if score >= need[t_] and score > best.get((d_, t_), (0,))[0]:
                base = lo_ - int(at[d_])
                best[d_, t_] = (score, base + s, base + e)

    for batch in batches:
        ids = np.asarray(batch.column(0))
        data, offs = utf8(batch.column(1))
        out = []
        for i, j in slices(offs):
            h, at = K.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            hits = []
            for n in range(GRAM, LONGEST + 1):
                x, of, first = grams(h, at, n)
                pos, k = known.find(x)
                hits.append((of[pos], first[pos] - at[of[pos]], k))
            of, word, k = (np.concatenate([x[c] for x in hits]) for c in range(3))
            if not len(of):
                continue
            order = np.argsort(of, kind="stable")
            of, word, k = of[order], word[order], k[order]
            many = begin[k + 1] - begin[k]
            total = np.cumsum(many)
            cuts, lo_ = [], 0
            while lo_ < len(of):  # documents that have about HITS hits together
                hi_ = int(np.searchsorted(total, (total[lo_ - 1] if lo_ else 0) + HITS, side="right"))
                hi_ = int(np.searchsorted(of, of[min(hi_, len(of) - 1)], side="left")) if hi_ < len(of) else len(of)
                hi_ = hi_ if hi_ > lo_ else int(np.searchsorted(of, of[lo_], side="right"))
                cuts.append((lo_, hi_))
                lo_ = hi_
            best: dict[tuple[int, int], tuple] = {}
            for p, q in cuts:
                m = many[p:q]
                entry = np.arange(m.sum()) + np.repeat(begin[k[p:q]] - (np.cumsum(m) - m), m)
                align(entry, np.repeat(of[p:q], m), np.repeat(word[p:q], m), h, at, best)
            out += [(ids[i + d_], items.ids[t_], s / (MATCH * float(length[t_])), a, b) for (d_, t_), (s, a, b) in best.items()]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score and words [first_word, last_word) of each document that holds an item."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    found = spark.createDataFrame([], RESULT)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # one block: size checked above
        some = Items([r.item_id for r in rows], [r.text for r in rows])
        if not len(some.gram):
            continue
        shared = spark.sparkContext.broadcast(some)
        counted = texts.mapInArrow(lambda it, s=shared: _count(it, s), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
        df, rows = np.zeros(len(some.grams), np.int64), 0
        for r in counted.collect():  # a row for each n-gram of the block
            if r.gram < 0:
                rows = r.df
            else:
                df[r.gram] = r.df
        shared.destroy()
        both = spark.sparkContext.broadcast((some, some.seeds(df, max(FEW, RARE * rows))))
        found = found.unionByName(texts.mapInArrow(lambda it, s=both: _align(it, s, threshold), RESULT))
    best = F.min(F.struct((-F.col("score")).alias("less"), "first_word", "last_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.less")).alias("score"), "b.first_word", "b.last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a test item."""
    bad = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
