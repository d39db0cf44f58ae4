"""SentencePiece unigram encoding and decoding.

Pieces and scores come from a public SentencePiece model file.  Viterbi finds
the segmentation with the highest sum of log scores over a double-array trie;
characters that no piece covers fall back to byte pieces.  A space is the
whitespace marker, and each text gets one in front.

No piece holds a marker behind another character, so a best path over a text is
the best paths over its runs (spaces and what follows up to the next space).
Texts are therefore cut into runs, equal runs are solved once (a worker remembers a
bounded number of them), and all new ones of a slice advance together in numpy: the trie walk by depth, Viterbi by
position.  A run is cut further wherever no piece crosses, which is exact too;
what stays longer than ``LONG`` bytes (a text without spaces) is solved by a
plain loop over its pieces, in time linear in its length.

Scale: the texts of a batch are handled in slices of about ``SLICE`` bytes, and
a longer text in parts that end between two of its runs or where no piece
crosses, so that memory depends neither on a batch's size nor on a text's length.

Defined results: nothing is cut off, whatever a text's length.  Decoding is
exact: a marker character in the text itself is kept apart by byte pieces.  Null
and empty texts have no tokens and decode to an empty text; of equally good
segmentations that with the longer last piece wins (scores are multiples of
2^-20, so sums are exact and ties are the same wherever a text is cut); rows are
encoded one by one, equal ones alike and null keys like any other; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import binary_column, slices, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY, SLICE, LONG, GRID = 10.0, 1 << 18, 96, 1 << 20
_RAW = K.stream(21, 256)


class DoubleArray:
    """A trie of byte strings in two arrays: child = base[node] + byte + 1, valid if check[child] == node."""

    def __init__(self, keys: list[bytes], values: list[int]):
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free = 1
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        todo = [(0, 0, 0, len(order))]  # node, depth, and the run of sorted keys below it
        for node, depth, lo, hi in todo:
            while lo < hi and len(keys[order[lo]]) == depth:
                value[node] = values[order[lo]]
                lo += 1
            if lo == hi:
                continue
            labels, cuts = [], []
            for i in range(lo, hi):
                b = keys[order[i]][depth]
                if not labels or labels[-1] != b:
                    labels.append(b)
                    cuts.append(i)
            cuts.append(hi)
            steps = np.array(labels, np.int64) + 1
            while check[free] >= 0:
                free += 1
            at, span = max(0, free - int(steps[0])), 64
            while True:  # look for a base at which all children are free, ever more at a time
                if at + span + 260 >= size:
                    grow = max(size, span)
                    base = np.concatenate([base, np.zeros(grow, np.int32)])
                    check = np.concatenate([check, np.full(grow, -1, np.int32)])
                    value = np.concatenate([value, np.full(grow, -1, np.int32)])
                    size += grow
                fits = np.ones(span, bool)
                for s in steps:
                    fits &= check[at + s : at + s + span] < 0
                if fits.any():
                    at += int(fits.argmax())
                    break
                at, span = at + span, min(2 * span, 1 << 14)
            base[node] = at
            check[at + steps] = node
            for k, s in enumerate(steps):
                todo.append((at + int(s), depth + 1, cuts[k], cuts[k + 1]))
        self.base, self.check, self.value = base, check, value


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = buf[i]
        i += 1
        x |= (b & 0x7F) << shift
        if b < 0x80:
            return x, i
        shift += 7


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol buffer message."""
    i = 0
    while i < len(buf):
        tag, i = _varint(buf, i)
        kind = tag & 7
        if kind == 0:
            x, i = _varint(buf, i)
        elif kind == 2:
            n, i = _varint(buf, i)
            x, i = buf[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            x, i = buf[i : i + n], i + n
        yield tag >> 3, x


class Memory:
    """Ids of runs solved before, by the runs' hashes: a text's words come again and again."""

    RUNS, IDS = 1 << 18, 1 << 21  # beyond these all is forgotten

    def __init__(self):
        self.place: dict[int, int] = {}
        self.begin, self.count, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def places(self, h: np.ndarray) -> np.ndarray:
        get = self.place.get
        return np.array([get(x, -1) for x in h.tolist()], np.int64)

    def full(self, runs: int, ids: int) -> bool:
        return len(self.place) + runs > self.RUNS or self.used + ids > self.IDS

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def add(self, h: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        n = len(self.place)
        self.begin, self.count, self.ids = self._room(self.begin, n + len(h)), self._room(self.count, n + len(h)), self._room(self.ids, self.used + len(ids))
        self.begin[n : n + len(h)] = begin[:-1] + self.used
        self.count[n : n + len(h)] = np.diff(begin)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(h.tolist(), range(n, n + len(h))))
        return np.arange(n, n + len(h))

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids, self.begin[place], self.count[place]


def _uncrossed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The places of 0 to n - 1 that lie inside no arc."""
    inner = b - a > 1
    crossed = np.bincount(a[inner] + 1, minlength=n + 1)[:n] - np.bincount(b[inner], minlength=n + 1)[:n]
    return np.flatnonzero(np.cumsum(crossed) == 0)


def _followed(back: np.ndarray, a: np.ndarray, at: int, begin: int) -> Iterator[int]:
    """The arcs of a best path from ``at`` back to ``begin``."""
    while at > begin:
        arc = int(back[at])
        yield arc
        at = int(a[arc])


class Unigram:
    """Pieces with log scores, encoder and decoder.

    ``rank_scores``: the file holds negative merge ranks in place of log scores, as
    models of merges do.  They say nothing of how likely a piece is, so a Zipf law
    is assumed: a piece of rank r gets -log(1 + r).  False takes scores as they are.
    """

    def __init__(self, raw: bytes, rank_scores: bool = True):
        pieces, scores, kinds = [], [], []
        for number, x in _fields(raw):
            if number == 1:
                f = dict(_fields(x))
                pieces.append(f[1].decode())
                scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(f.get(3, 1))
        self.pieces = pieces
        score = np.array(scores)
        normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
        if rank_scores:
            least = len(pieces)
            score = -np.log1p(np.where(-score > least, least, -score))
        score = np.round(score * GRID) / GRID
        self.score = score
        self.unknown = float(score[normal].min()) - UNKNOWN_PENALTY
        surface = [b""] * len(pieces)
        self.byte_piece = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == 6:
                b = int(pieces[i][3:5], 16)
                self.byte_piece[b] = i
                surface[i] = bytes([b])
        keys = []
        for i in normal:
            surface[i] = pieces[i].replace("▁", " ").encode()
            if b" " in surface[i].lstrip(b" "):
                raise ValueError(f"a piece holds white space behind another character: {pieces[i]!r}")
            keys.append(surface[i])
        if (self.byte_piece < 0).any():
            raise ValueError("the model has no byte pieces")
        self.trie = DoubleArray(keys, normal)
        self.longest = max(map(len, keys))
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(s) for s in surface])]).astype(np.int64)
        self._memory = Memory()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": Memory()}  # each worker remembers for itself

    # ------------------------------------------------------------------ encoding

    def _arcs(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From, to and piece (-1: unknown) of all pieces that occur within runs, and of characters that none covers."""
        end = np.repeat(offs[1:], np.diff(offs))
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(starts, len(data)))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        state, at, origin = np.zeros(len(starts), np.int32), starts.copy(), np.arange(len(starts))
        arc_from, arc_to, arc_piece = [], [], []
        alone = np.zeros(len(starts), bool)  # a piece covers just this character
        while len(at):
            nxt = base[state] + data[at] + 1
            ok = check[nxt] == state
            state, at, origin = nxt[ok], at[ok] + 1, origin[ok]
            hit = np.flatnonzero(value[state] >= 0)
            if len(hit):
                o = origin[hit]
                arc_from.append(starts[o])
                arc_to.append(at[hit])
                arc_piece.append(value[state[hit]])
                alone[o[at[hit] - starts[o] == width[o]]] = True
            go = at < end[starts[origin]] if len(at) else np.zeros(0, bool)
            state, at, origin = state[go], at[go], origin[go]
        none = np.flatnonzero(~alone)
        arc_from.append(starts[none])
        arc_to.append(starts[none] + width[none])
        arc_piece.append(np.full(len(none), -1, np.int32))
        return np.concatenate(arc_from), np.concatenate(arc_to), np.concatenate(arc_piece)

    def _solve(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each run, and where each run's begin."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        a, b, p = self._arcs(data, offs)
        order = np.lexsort((a, b))
        a, b, p = a[order], b[order], p[order]
        gain = np.where(p >= 0, self.score[p], self.unknown)
        # a best path passes through every place that no piece crosses: parts between these are solved by themselves
        cuts = np.append(_uncrossed(a, b, n), n)
        part = np.searchsorted(cuts, a, side="right") - 1
        rel = b - cuts[part]
        best = np.full(n + 1, -np.inf)
        back = np.full(n + 1, -1, np.int64)
        best[cuts[:-1]] = 0.0
        last = np.full(len(cuts) - 1, -1, np.int64)  # the arc that ends each part: its end is the next one's begin
        short = (np.diff(cuts) <= LONG)[part]
        some = np.flatnonzero(short)
        some = some[np.argsort(rel[some], kind="stable")]
        sa, sb, sg, sr = a[some], b[some], gain[some], rel[some]
        steps = np.flatnonzero(np.diff(np.append(-1, sr)))
        for lo, hi in zip(steps, np.append(steps[1:], len(sr))):
            cand = best[sa[lo:hi]] + sg[lo:hi]
            node = sb[lo:hi]
            first = np.flatnonzero(np.diff(np.append(-1, node)))
            top = np.maximum.reduceat(cand, first)
            win = np.flatnonzero(cand == np.repeat(top, np.diff(np.append(first, hi - lo))))
            keep = win[np.unique(node[win], return_index=True)[1]]  # of equal sums the longest last piece, as it comes first
            inside = cuts[part[some[lo + first]] + 1] != node[first]
            best[node[first[inside]]] = top[inside]
            back[node[keep[inside]]] = some[lo + keep[inside]]
            last[part[some[lo + first[~inside]]]] = some[lo + keep[~inside]]
        for k in np.flatnonzero(np.diff(cuts) > LONG):
            self._walk(a, b, gain, int(cuts[k]), int(cuts[k + 1]), back, last, k)
        # the paths, from the ends of the parts back to their begins
        chosen = [last]
        cur, begin = a[last], cuts[:-1]
        go = cur > begin
        cur, begin = cur[go], begin[go]
        while len(cur):
            if len(cur) <= 8:  # only long ones are left: follow each by itself
                chosen.append(np.array([x for c, s in zip(cur.tolist(), begin.tolist()) for x in _followed(back, a, c, s)], np.int64))
                break
            arc = back[cur]
            chosen.append(arc)
            cur = a[arc]
            go = cur > begin
            cur, begin = cur[go], begin[go]
        arc = np.concatenate(chosen)
        arc = arc[np.argsort(a[arc], kind="stable")]
        piece, size = p[arc], np.where(p[arc] >= 0, 1, b[arc] - a[arc])
        ids = np.repeat(piece, size)
        if (piece < 0).any():
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
            raw = data[np.repeat(a[arc], size) + np.where(ids < 0, inside, 0)]
            ids = np.where(ids < 0, self.byte_piece[raw], ids)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids.astype(np.int32), total[np.searchsorted(a[arc], offs)]

    @staticmethod
    def _walk(a: np.ndarray, b: np.ndarray, gain: np.ndarray, lo: int, hi: int, back: np.ndarray, last: np.ndarray, k: int) -> None:
        """The same for one long part, arc by arc; arcs are sorted by their ends."""
        i, j = int(np.searchsorted(b, lo, side="right")), int(np.searchsorted(b, hi, side="right"))
        best, via = [float("-inf")] * (hi - lo + 1), [-1] * (hi - lo + 1)
        best[0] = 0.0
        for arc, (x, y, g) in enumerate(zip((a[i:j] - lo).tolist(), (b[i:j] - lo).tolist(), gain[i:j].tolist()), i):
            s = best[x] + g
            if s > best[y]:
                best[y], via[y] = s, arc
        back[lo + 1 : hi] = via[1:-1]
        last[k] = via[-1]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and where each text's begin."""
        ids, counts = [], []
        for i, j in slices(offs, SLICE):
            if j == i + 1 and offs[j] - offs[i] > 2 * SLICE:
                each = [x for x, _ in self._parts(data[offs[i] : offs[j]])]
                ids += each
                counts.append(np.array([sum(map(len, each))], np.int64))
            else:
                x, begin = self._encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids.append(x)
                counts.append(np.diff(begin))
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]).astype(np.int64)

    def _parts(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A long text in parts that end between two runs or, within a long run, where no piece crosses."""
        lo = 0
        while lo < len(text):
            blank = text[lo + SLICE : lo + 2 * SLICE] == 0x20
            end = np.flatnonzero(blank[1:] & ~blank[:-1])
            hi = lo + SLICE + int(end[0]) + 1 if len(end) else len(text) if lo + 2 * SLICE >= len(text) else self._inner_end(text, lo)
            yield self._encode(text[lo:hi], np.array([0, hi - lo]), lo == 0)
            lo = hi

    def _inner_end(self, text: np.ndarray, lo: int) -> int:
        """A place behind ``lo`` that no piece crosses, after about ``SLICE`` bytes if there is one."""
        size = SLICE
        while lo + size < len(text):
            seen = text[lo : lo + size + self.longest]
            a, b, _ = self._arcs(seen, np.array([0, len(seen)]))
            free = _uncrossed(a, b, len(seen))
            free = free[(free > 0) & (free <= size)]
            if len(free):
                return lo + int(free[-1])
            size *= 2
        return len(text)

    def _encode(self, data: np.ndarray, offs: np.ndarray, front: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The same of a slice; ``front``: a space goes before each text."""
        lens = np.diff(offs)
        extra = ((lens > 0) & front).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(lens + extra)])
        text = np.full(at[-1], 0x20, np.uint8)
        mark = at[:-1][lens > 0]
        body = np.ones(at[-1], bool)
        body[mark] = not front
        text[body] = data
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        blank = text == 0x20
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[mark] = True
        starts = np.flatnonzero(cut)
        h = K.run_hashes(text, starts, _RAW)
        each, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = self._memory.places(each)
        new = np.flatnonzero(place < 0)
        if len(new):
            size = np.diff(np.append(starts, len(text)))
            length = size[first[new]]
            ends = np.concatenate([[0], np.cumsum(length)])
            pick = np.arange(ends[-1]) + np.repeat(starts[first[new]] - ends[:-1], length)
            ids, begin = self._solve(text[pick], ends)
            if self._memory.place and self._memory.full(len(new), len(ids)):
                self._memory = Memory()  # what is known would be forgotten: solve all of this slice
                return self._encode(data, offs, front)
            place[new] = self._memory.add(each[new], ids, begin)
        ids, begin, count = self._memory.of(place[which])
        total = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return out, total[np.searchsorted(starts, at)]

    # ------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text begins; the space put in front goes."""
        size = self.ends[ids + 1] - self.ends[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.arange(at[-1]) + np.repeat(self.ends[ids] - at[:-1], size)]
        offs = at[begin]
        keep = np.ones(len(raw), bool)
        front = offs[:-1][offs[1:] > offs[:-1]]
        keep[front[raw[front] == 0x20]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return raw[keep], kept[offs]

    def encode_text(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0].tolist()

    def decode_ids(self, ids: list[int]) -> str:
        return self.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode()


_LOADED: dict[tuple, Unigram] = {}


def load(path: str | None = None, rank_scores: bool = True) -> Unigram:
    key = (path or os.environ.get("TRACEWRIGHT_PIECES", MODEL), rank_scores)
    if key not in _LOADED:
        with open(key[0], "rb") as f:
            _LOADED[key] = Unigram(f.read(), rank_scores)
    return _LOADED[key]


def _tokenize(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    model = shared.value
    names = ["row_id", "tokens", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]
    for batch in batches:
        data, offs = utf8(batch.column(1))
        for i, j in slices(offs, 4 * SLICE):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            ids, begin = model.encode(part, at)
            back, back_at = model.decode(ids, begin)
            same = np.diff(at) == np.diff(back_at)
            if len(part) == len(back) and same.all():
                wrong = np.searchsorted(at, np.flatnonzero(part != back), side="right") - 1
                same[wrong] = False
            crc = lambda x, o: pa.array([zlib.crc32(x[a:b].tobytes()) for a, b in zip(o[:-1], o[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)),
                    pa.array(np.diff(begin).astype(np.int32)), crc(ids, begin), crc(back, back_at), pa.array(same),
                ],
                names,
            )


def _detokenize(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    model = shared.value
    for batch in batches:
        col = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        begin = np.asarray(col.offsets).astype(np.int64)
        ids = np.asarray(col.values).astype(np.int64)[begin[0] : begin[-1]]
        raw, offs = model.decode(ids, begin - begin[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(raw, offs, pa.string())], ["row_id", "text"])


def tokenize(docs: DataFrame, model: Unigram | None = None, key: str = "doc_id") -> DataFrame:
    """key, tokens, n_tokens, checksums of ids and decoded text, and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load())  # a vocabulary: fixed size
    out = docs.select(F.col(key).cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    kind = "row_id long, tokens array<int>, n_tokens int, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return out.mapInArrow(lambda it: _tokenize(it, shared), kind).withColumnRenamed("row_id", key)


def detokenize(tokens: DataFrame, model: Unigram | None = None, key: str = "doc_id") -> DataFrame:
    """key and text of token arrays."""
    shared = tokens.sparkSession.sparkContext.broadcast(model or load())
    out = tokens.select(F.col(key).cast("long").alias("row_id"), "tokens")
    return out.mapInArrow(lambda it: _detokenize(it, shared), "row_id long, text string").withColumnRenamed("row_id", key)


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))
