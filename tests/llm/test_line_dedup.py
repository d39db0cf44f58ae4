import random

import numpy as np

from tracewright.llm import line_dedup as L

DOC = "doc_id long, text string, line int, n_near string"


def norm(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).split()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=L.LEAST_WORDS):
    lines = [(i, k, tuple(norm(x)), x) for i, t in sorted(r for r in rows if r[0] is not None and r[1] is not None) for k, x in enumerate(t.split("\n"))]
    first, seen = [], set()
    for i, k, n, _ in lines:
        if n and n not in seen:
            seen.add(n)
            first.append((i, k, n))
    gone = {(i, k) for p, (i, k, n) in enumerate(first) if len(n) >= least and any(len(m) >= least and near(m, n) for _, _, m in first[:p])}
    stay = {(i, k) for i, k, _ in first} - gone
    out = {}
    for i, k, n, raw in lines:
        if not n or (i, k) in stay:
            out.setdefault(i, []).append(raw)
        else:
            out.setdefault(i, [])
    return {i: "\n".join(v) for i, v in out.items()}


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    pool = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(0, 6)):
            w = rng.choice(pool).split()
            edit = rng.random()
            if edit < 0.2:
                w[rng.randrange(len(w))] = word()
            elif edit < 0.3:
                w.insert(rng.randrange(len(w) + 1), word())
            elif edit < 0.4 and len(w) > 1:
                del w[rng.randrange(len(w))]
            text.append(" ".join(w) if rng.random() < 0.9 else "")
        rows.append((i, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "long " * 20000), (204, "long " * 20001), (205, "x" * 100000), (206, "Éé çà  ü"), (207, "éé çà  ü")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "e") for i, t in rows], DOC)
    got = {r.doc_id: r.text for r in L.dedup_lines(df, digest=True).collect()}
    want = {i: None for i, t in rows if t is None} | brute(rows)
    assert got == want
    left = L.dedup_lines(df)
    assert left.columns == df.columns
    full = {i: t for i, t in rows}
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept == {i: t for i, t in want.items() if not (full[i] and full[i].split() and not (t or "").split())}


def test_empty_null_and_repeated(spark):
    assert L.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    rows = spark.createDataFrame([(None, "a b", None, None), (None, "a b", None, None), (5, "a b", 1, None), (5, "a b", 1, None), (6, "A  b", 1, None)], DOC)
    got = sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(rows).collect())
    assert got == [(0, "a b"), (0, "a b"), (5, "a b"), (5, "a b")]


def test_hot_template(spark):
    """Lines that differ in one word at one place: the earliest stays."""
    rows = [(i, f"reply by user u{i} on the topic of the day") for i in range(500)]
    got = [r.doc_id for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [0]


def test_one_edit():
    a = np.arange(10)
    assert L.within_one_edit(a, a) and L.within_one_edit(a, np.delete(a, 3)) and L.within_one_edit(np.insert(a, 0, 99), a)
    assert not L.within_one_edit(a, np.delete(a, [1, 2])) and not L.within_one_edit(a, np.roll(a, 1))


def test_different_texts_under_one_id(spark):
    rows = [(1, "alpha beta gamma"), (2, "alpha beta gamma\nsecond line here"), (2, "unique words stay"), (2, "ALPHA beta gamma"), (3, "second line here")]
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "alpha beta gamma"), (2, "second line here"), (2, "unique words stay")]


def test_short_lines(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f X"), (3, "one two three four"), (4, "one two three five"), (5, "one two three"), (6, "one two six")]
    got = sorted(r.doc_id for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [1, 3, 5, 6]
