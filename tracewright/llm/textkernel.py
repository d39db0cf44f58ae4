"""Words, word hashes and shingle hashes of many UTF-8 texts at once, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; only A-Z are lower-cased.  All of these are single
bytes that never occur inside a longer UTF-8 sequence, so bytes can be used
throughout.  Equal words have equal 64-bit hashes on every machine.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = U64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` well mixed 64-bit numbers that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * _GOLD)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_VALUE = stream(7, 256)[FOLD]
_VALUE[SPACE] = 0
_POW = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 2 * len(_POW), 4096), _BASE)
            steps[0] = 1
            _POW = np.cumprod(steps)
    return _POW


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words begin (one more entry than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    full = offs[1:] > offs[:-1]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def run_hashes(data: np.ndarray, starts: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """Hash of the bytes from each start up to the next; bytes of value 0 at a run's end don't count."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    d = data[starts[0] :]
    s = starts - starts[0]
    lens = np.diff(np.append(s, len(d)))
    pos = np.arange(len(d)) - np.repeat(s, lens)
    with np.errstate(over="ignore"):
        v = value[d] * _powers(int(lens.max()))[pos]
        return mix(np.add.reduceat(v, s))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin."""
    starts, _, at = words(data, offs)
    return run_hashes(data, starts), at


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (positions up to len - n)."""
    with np.errstate(over="ignore"):
        acc = h[: len(h) - n + 1] * U64(0xD6E8FEB86659FD93) + U64(n)
        for j in range(1, n):
            acc = (acc ^ (acc >> U64(29))) * _M2 + h[j : len(h) - n + 1 + j]
        return mix(acc)


def shingles(h: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``n``-word shingles of all texts with the text each is of, and the start of each text.

    A text of fewer words, but some, has one shingle: all its words.
    """
    count = np.diff(at)
    docs = np.arange(len(count))
    out, who = [], []
    if len(h) >= n:
        of = np.repeat(docs, count)
        whole = of[: len(h) - n + 1] == of[n - 1 :]
        out.append(chain(h, n)[whole])
        who.append(of[: len(h) - n + 1][whole])
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            out.append(chain(h, m)[at[:-1][short]])
            who.append(short)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    x, who = np.concatenate(out), np.concatenate(who)
    if len(out) > 1:
        order = np.argsort(who, kind="stable")
        x, who = x[order], who[order]
    return x, who, np.searchsorted(who, np.arange(len(count) + 1))


class Lookup:
    """Positions of known hashes (sorted) among many."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(known >> U64(44)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``x`` known hashes are, and which."""
        at = np.flatnonzero(self.seen[(x >> U64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.known, x[at])
        ok = self.known[np.minimum(k, len(self.known) - 1)] == x[at]
        return at[ok], k[ok]
