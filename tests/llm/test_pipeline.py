import corpus_pipeline as P
from tracewright.llm import decontaminate, langid, line_dedup, minhash_forest

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra array<int>"


def small(spark):
    say = lambda k, n: " ".join(f"{w}{(k * 7 + i) % 50}" for i, w in enumerate(["the", "and", "of", "house", "river", "walk"] * n))
    rows = [(i, say(i, 6) + "\n" + say(i + 100, 4), "en", "s1", 1, [1]) for i in range(20)]
    near = rows[3][1].replace("river", "stream", 1)
    rows += [(50, rows[2][1], "en", "s1", 1, None), (51, near, "en", "s1", 1, None), (60, None, "en", None, None, None), (61, "", None, None, None, None), (62, say(70, 3) + " planted benchmark words are right here in the text " + say(71, 3), "en", "s2", 1, [])]
    return spark.createDataFrame(rows, DOC)


def test_stages(spark, sf, tmp_path):
    spark.createDataFrame([(1, "planted benchmark words are right here in the text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = small(spark)
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "tokens":
            assert docs.dtypes == before.dtypes
    assert kept["language"] == set(range(20)) | {50, 51, 62}
    assert kept["lines"] == kept["language"] - {50, 51} and kept["benchmark"] == kept["near_duplicates"] - {62} == kept["tokens"]
    assert docs.where("not round_trip").count() == 0


def test_run_is_the_stages(spark, sf):
    """On the table: each stage against its operator's own decisions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = langid.keep_identified(docs).cache()
    b = line_dedup.dedup_lines(a).cache()
    c = b.join(minhash_forest.near_duplicates(b).where("kept").select("doc_id"), "doc_id", "left_semi").cache()
    bad = {r.doc_id for r in decontaminate.leaks(c, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {r.doc_id for r in c.collect()} - bad
    assert {r.doc_id for r in P.run(spark, sf).collect()} == want


def test_empty(spark, sf, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], DOC)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "tokens"]


def test_against_brute_force(spark, tmp_path):
    """Every stage against the brute-force version of its operator, each on what the brute force left of the one before."""
    import random
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    import test_decontaminate as benchmark
    import test_langid as language
    import test_line_dedup as lines
    import test_minhash_forest as near
    import test_unigram as pieces

    from pyspark.sql import functions as F
    from tracewright.llm import unigram

    rng = random.Random(17)
    vocab = {"en": [f"th{a}{b}ing" for a in "aeiou" for b in "nmrstl"], "de": [f"sch{a}{b}ung" for a in "äeöu" for b in "nmrstl"]}
    rows = []
    for i in range(90):
        la = "en" if i % 3 else "de"
        say = lambda n: " ".join(rng.choice(vocab[la]) for _ in range(n))  # noqa: B023, E731
        rows.append([i, "\n".join(say(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 5))), la if i % 5 else None, f"host{i % 4}"])
    for k in range(10):
        text = rows[k * 3][1].split(" ")
        text[-1] = "changed"
        rows.append([100 + k, " ".join(text).replace("\n", " "), "en", "host1"])  # the same words in one line: near, but no repeated line
        rows.append([200 + k, rows[k * 4][1], "en", "host1"])
    items = {k: rows[k * 7 + 1][1].replace("\n", " ").split(" ")[:20] for k in range(3)}
    for k in range(6):
        edited = [*items[k % 3]]
        edited[3] = "other"
        rows.append([300 + k, " ".join(rng.choice(vocab["en"]) for _ in range(20 + k)) + " " + " ".join(edited), "en", "host2"])
    rows += [[400, None, "en", "h"], [401, " \n", None, None], [402, "漢字だけの文" * 3, None, "h"], [403, "thaning " * 3000, "en", "host3"]]
    spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda docs: spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], schema)
    stages = dict(P.STAGES)
    run = lambda name, docs: {r.doc_id: r for r in stages[name](spark, frame(docs), str(tmp_path)).collect()}

    got = run("language", rows)
    model = langid.fit(frame(rows))
    sample = frame(rows).where("text is not null and lang is not null").where(langid.sampled(F.col("text"), F.col("lang"), model.share)).select("text", "lang").distinct().collect()
    want = language.plain([(t, la, h) for _, t, la, h in rows], [tuple(r) for r in sample])
    left = [[i, t, la, h] for (i, t, _, h), (la, _, kept) in zip(rows, want) if kept]
    assert {i: r.lang for i, r in got.items()} == {r[0]: r[2] for r in left} and 400 not in got and 401 not in got

    got, kept = run("lines", left), lines.brute([(r[0], r[1]) for r in left])
    left = [[i, kept[i], la, h] for i, _, la, h in left if kept[i].split()]
    assert {i: (r.text, r.n_chars) for i, r in got.items()} == {r[0]: (r[1], len(r[1])) for r in left}

    got, groups = run("near_duplicates", left), near.brute([(r[0], r[1]) for r in left])
    left = [r for r in left if groups[r[0]][1] == r[0]]
    assert set(got) == {r[0] for r in left} and len(left) < len(groups)

    got = run("benchmark", left)
    holds = lambda t: any(benchmark.model(near.words(t), v) >= decontaminate.THRESHOLD * decontaminate.MATCH * len(v) for v in items.values())
    clean = [r for r in left if len(r[1].split()) > 2000 or not holds(r[1])]
    assert set(got) == {r[0] for r in clean} and len(clean) < len(left)

    got, model = run("tokens", clean), unigram.load()
    assert set(got) == {r[0] for r in clean} and all(r.round_trip for r in got.values())
    for i, t, _, _ in clean:
        assert got[i].tokens == model.encode_text(t)
        if len(t) < 400:
            assert pieces.score(model, t) == pieces.best_score(model, t)
