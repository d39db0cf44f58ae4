import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import minhash_forest as M
from tracewright.llm import textkernel as K

DOC = "doc_id long, text string, extra string, component_id int"


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, now = [], ""
    for c in fold:
        if c in " \t\n\x0b\x0c\r":
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out + ([now] if now else [])


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(flat):
        for j, t in flat[k + 1 :]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (max(len(s) for s in ss), find(i)) for i, ss in sets.items()}


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(60)]
    n = 100
    for base in range(0, 60, 3):  # copies and edited copies
        w = rows[base][1].split()
        for edits in (0, 0, 1, 2, len(w) // 10):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = word()
            rows.append((n, " ".join(v)))
            n += 1
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  B"), (505, "Ünï çödé"), (506, "x " * 30000), (507, "nospace" * 9000), (508, "nospace" * 9000), (509, None)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = M.near_duplicates(spark.createDataFrame([(i, t, "e", 1) for i, t in rows], DOC)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups(spark):
    """Many equal texts and many slightly different ones are one group each; the rest is left alone."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(400)]
    for i in range(400):
        v = [*base]
        v[rng.randrange(200)] = f"e{i}"
        rows.append((1000 + i, " ".join(v)))
    rows += [(5000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(50))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i, _ in rows[:800]} == {0} and all(got[5000 + i] == 5000 + i for i in range(100))


def test_empty_and_null_ids(spark):
    assert M.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, "a b c d e f", None, None)], DOC)
    assert [tuple(r) for r in M.near_duplicates(rows).orderBy("doc_id").collect()] == [(1, 2, 1, True, 1.0), (2, 2, 1, False, 1.0)]
    assert sorted((r.doc_id is None, r.doc_id) for r in M.keep_first(rows).collect()) == [(False, 1), (False, 1), (True, None)]


def test_kernel_words():
    texts = ["a b", "", " x\ty ", "Ä ß\x0bZ", "\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    s, e, at = K.words(data, offs)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["a", "b", "x", "y", "Ä", "ß", "Z"] and at.tolist() == [0, 2, 2, 4, 7, 7]


def test_adaptive_depth():
    lcp = np.array([1, 1] + [3] * 40 + [0, 5])
    d = M.adaptive_depth(lcp)
    assert d[:2].tolist() == [2, 2] and (d[2:43] == M.MOST_DEPTH).all() and d[43:].tolist() == [M.LEAST_DEPTH] * 2


def test_pairs_in_crowded_regions(spark):
    """A pair is found among many texts that share a long passage with it, but not enough to link."""
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(6):
        passage = word(140)
        rows += [(1000 * k + i, " ".join(passage + word(70))) for i in range(200)]
        rows += [(1000 * k + i, " ".join(passage + word(20))) for i in (500, 501)]
        want[1000 * k + 501] = 1000 * k + 500
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want.get(i, i) for i, _ in rows}


def test_prefix_lengths():
    """Two sets that reach the threshold share one of their first shingles in any order."""
    rng = random.Random(4)
    for _ in range(2000):
        x, y = ({rng.randrange(24) for _ in range(rng.randrange(1, 40))} for _ in range(2))
        x, y = sorted((x, y), key=len)
        if 100 * len(x & y) >= 75 * len(x | y):
            assert set(sorted(y)[: M.prefix_lengths(len(y), 75)[0]]) & set(sorted(x)[: M.prefix_lengths(len(x), 75)[1]])


def test_group_around_a_late_text(spark):
    """Copies that link with one text, but not with one another, are one group, wherever that text's id lies."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = [(700, " ".join(base))]
    for i in range(600):
        v = [*base]
        for at in rng.sample(range(0, 300, 5), 7):
            v[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(v)))
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for _, c in want.values()} == {0} and got == want


def test_candidates_do_not_depend_on_batches():
    """Depths, candidates and crowded texts are the same however sorted rows are cut into batches."""
    rng = np.random.default_rng(7)
    key = np.sort(rng.integers(0, 3, (400, M.DEPTH)).astype(">u2").view(f"S{2 * M.DEPTH}").ravel())
    key = key.astype(f"S{2 * M.DEPTH}")
    raw = [bytes(k).ljust(2 * M.DEPTH, b"\0") for k in key]
    bits = [bytes(M.TREES * M.DEPTH // 8)] * 400
    whole = pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], 200).astype(np.int32)), pa.array(raw, pa.binary()), pa.array(rng.permutation(400)), pa.array(bits, pa.binary())], ["tree", "key", "doc_id", "bits"])

    def run(size):
        out = M._neighbours(iter([whole.slice(i, size) for i in range(0, 400, size)]), 0.5)
        return sorted({(a, b) for batch in out for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())})

    want = run(400)
    assert want and all(run(size) == want for size in (1, 7, 19, 50, 399))


def test_audit_sees_what_the_forest_lacks(spark, monkeypatch):
    """Without any candidates every link of an audited text is missed: that is an error; with a low bar it is mended."""
    rng = random.Random(11)
    rows = []
    for k in range(40):
        w = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.audit_recall for r in M.near_duplicates(df).collect()} == {1.0}
    monkeypatch.setattr(M, "links_of", lambda pairs, sets, per_cent: pairs.select("a", "b").where("false"))
    with pytest.raises(RuntimeError, match="audited links"):
        M.near_duplicates(df)
    monkeypatch.setattr(M, "LEAST_RECALL", 0.0)
    got = M.near_duplicates(df).collect()
    assert {r.audit_recall for r in got} == {0.0} and {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i in range(80)}


def test_long_texts(spark):
    """Texts of a hundred thousand words are compared whole."""
    rng = random.Random(12)
    w = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    near, far = [*w], [*w]
    for at in rng.sample(range(100_000), 2000):
        near[at] = "n"
    for at in rng.sample(range(100_000), 9000):
        far[at] = "f"
    rows = [(3, " ".join(w)), (1, " ".join(near)), (2, " ".join(far))]
    assert {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 1}


def test_pairs_between_texts_without_links_are_given_once(spark):
    """Only what has a hub of its own is compared three times."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(10, 20)] + [(1, 30)], "a long, b long")
    links = spark.createDataFrame([(0, 1), (0, 2), (30, 31), (31, 32)], "a long, b long")
    label = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (30, 30), (31, 30), (32, 30)], "id long, component_id long")
    out = M.between(pairs, links, label)
    assert sorted(tuple(r) for r in out.collect()) == sorted([(i, i + 1) for i in range(10, 20)] + [(1, 30), (1, 31), (0, 30)])
    node = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(" in node
