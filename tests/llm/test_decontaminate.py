import random

import numpy as np

from tracewright.llm import decontaminate as D

DOC = "doc_id long, text string, item_id string, score string"
ITEM = "item_id long, text string, doc_id int"


def model(x, y):
    """Plain Smith-Waterman score."""
    best, row = 0, [0] * (len(x) + 1)
    for b in y:
        new = [0]
        for j, a in enumerate(x, 1):
            new.append(max(0, row[j - 1] + (D.MATCH if a == b else D.MISMATCH), row[j] + D.GAP, new[-1] + D.GAP))
        row = new
        best = max(best, *row)
    return best


def test_smith_waterman():
    rng = random.Random(0)
    for _ in range(200):
        x = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
        y = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
        score, lo, hi = D.smith_waterman(x, y)
        assert score == model(x, y) == (model(x[lo:hi], y) if score else 0)


def setup():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: say(rng.randrange(15, 50)) for i in range(30)}
    docs, held = [], set()
    for i in range(200):
        w = say(rng.randrange(5, 300))
        if i % 4 == 0:
            k = rng.randrange(30)
            p = list(items[k])
            for _ in range(len(p) * (i % 3) // 8):  # up to a quarter replaced
                p[rng.randrange(len(p))] = rng.choice(vocab)
            if i % 8 == 0:
                del p[len(p) // 2]
            at = rng.randrange(len(w))
            w[at:at] = p
            held.add((i, k))
        docs.append((i, " ".join(w)))
    return docs, items, held


def test_against_brute_force(spark):
    docs, items, held = setup()
    rows = spark.createDataFrame([(i, t, "s", "x") for i, t in docs], DOC)
    bench = spark.createDataFrame([(k, " ".join(v).upper(), 1) for k, v in items.items()], ITEM)
    want = {}
    for i, t in docs:
        w = t.split()
        for k, v in items.items():
            s = model(w, v) / (D.MATCH * len(v)) if len(set(w) & set(v)) * 2 > len(set(v)) * 0.4 else 0
            if s >= D.THRESHOLD:
                want[i, k] = s
    got = {(r.doc_id, r.item_id): r.score for r in D.leaks(rows, bench).collect()}
    assert held <= set(want) and got == want
    blocks = {(r.doc_id, r.item_id): r.score for r in D.leaks(rows, bench, block_bytes=2000).collect()}
    assert blocks == got
    left = D.decontaminate(rows, bench)
    assert left.columns == rows.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (None, "one two three four", None, None), (3, "one two three four", None, None), (3, "one two three four", None, None), (4, "x " * 50000 + "one two three four", "a", "b"), (5, "two", None, None)], DOC)
    bench = spark.createDataFrame([(1, "One two THREE four", 1), (2, None, 1), (3, "", 1), (None, "one two three four", 1), (4, "one two three four", None), (5, "two", 1)], ITEM)
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect())
    assert got == [(3, 1), (3, 4), (4, 1), (4, 4), (5, 5)]
    assert sorted((r.doc_id or 0) for r in D.decontaminate(docs, bench).collect()) == [0, 1, 2]
    assert D.leaks(spark.createDataFrame([], DOC), bench).count() == 0 and D.leaks(docs, spark.createDataFrame([], ITEM)).count() == 0


def test_copied_everywhere(spark):
    """An item that a third of all documents hold is found in all of them."""
    docs, items, _ = setup()
    many = [(1000 + i, "some words before " + " ".join(items[0]) + " and after") for i in range(300)]
    rows = spark.createDataFrame([*docs, *many], "doc_id long, text string")
    got = {r.doc_id for r in D.leaks(rows, spark.createDataFrame([(0, " ".join(items[0]), 0)], ITEM)).collect()}
    assert {i for i, _ in many} <= got


def test_seeds_are_rare():
    """A pair of words that many documents hold is lengthened until few do."""
    items = D.Items([1], ["of the old mill by the river in the spring of the year"])
    text = items.h.tolist()
    df = np.zeros(len(items.grams), np.int64)
    for n in range(D.GRAM, D.LONGEST + 1):
        x, _, first = D.grams(items.h, items.at, n)
        for g, f in zip(x, first):
            df[np.searchsorted(items.grams, g)] = 1000 if n == 2 and f in (0, 5, 7, 10) else 3 if n == 2 else 1
    found, begin, _, place = items.seeds(df, 20)
    own = df[np.searchsorted(items.grams, found)]
    assert own.max() <= 3 and begin[-1] == len(place) and set(np.diff(np.sort(place))) <= {1, 2} and len(text) == 13


def test_common_seeds_cost_no_alignments(spark, monkeypatch):
    """Documents full of an item's commonest pair are not aligned with it."""
    docs = [(i, "of the " * 50 + f"w{i}") for i in range(300)] + [(999, "x y the spring of the old year z")]
    bench = spark.createDataFrame([(0, "the spring of the old year came", 0)], ITEM)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert [(r.doc_id, r.first_word, r.last_word) for r in D.leaks(rows, bench).collect()] == [(999, 2, 8)]


def test_ties_and_shared_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f x x x x x x x x x x x x a b c d e f"), (2, "q q a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id, r.score, r.first_word, r.last_word) for r in D.leaks(docs, spark.createDataFrame([(0, "a b c d e f", 0)], ITEM)).collect())
    assert got == [(1, 1.0, 0, 6), (2, 1.0, 0, 6)]


def test_recall_on_edited_copies(spark):
    """Copies with a fifth of their words replaced, among documents that share the common words."""
    rng = random.Random(8)
    common, vocab = "the of and to in a is that it for".split(), [f"w{k}" for k in range(3000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(n)]
    items = {k: say(30) for k in range(40)}
    docs = [(i, say(200)) for i in range(800)]
    for i, w in docs[:200]:
        p = list(items[i % 40])
        for x in rng.sample(range(30), 6):
            p[x] = rng.choice(vocab)
        w[50:50] = p
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(rows, spark.createDataFrame([(k, " ".join(v), 0) for k, v in items.items()], ITEM)).collect()}
    found = sum((i, i % 40) in got for i in range(200))
    assert found >= 196 and not [i for i, _ in got if i >= 200]
