import math

import pytest
from pyspark.sql import functions as F

from tracewright.llm import langid as G

DOC = "doc_id long, text string, lang string, source string, host string, posterior double, row int"


def test_held_out_accuracy(spark, sf):
    """Text alone, on documents the model hasn't seen, with declarations and hosts withheld."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = G.fit(docs.where(half == 0))
    test = docs.where(half == 1)
    got = G.identify(test, F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), model).select("row.lang", "lang_id", "kept")
    right = got.where("lang = lang_id").count() / got.count()
    assert right >= 0.97 and got.where("kept").count() >= 0.97 * got.count()


def test_evidence_moves_short_texts(spark):
    train = [(i, t, la, f"http://{la}.example.{la}/") for i in range(30) for la, t in (("en", "the cat and the dog went to the house"), ("de", "der Hund und die Katze gingen nach dem Haus"))]
    rows = spark.createDataFrame([*train, (900, "taxi", "de", "http://de.example.de/"), (901, "taxi", "en", "http://en.example.uk/")], "doc_id long, text string, lang string, url string")
    got = {r.doc_id: r.lang_id for r in G.identify(rows, F.col("text"), F.col("lang"), F.col("url")).select("row.doc_id", "lang_id").collect()}
    assert got[900] == "de" and got[901] == "en"


def test_host_prior_leaves_the_document_out(spark):
    """One text's own count is no evidence for itself, and a host's majority counts."""
    rows = [(i, "the cat and the dog went home", "en", "h1", None, None, None) for i in range(40)] + [(i, "der Hund und die Katze", "de", "h2", None, None, None) for i in range(100, 140)]
    rows += [(500, "qq", None, "h1", None, None, None), (501, "qq", None, "h2", None, None, None)]
    got = {r.doc_id: r.lang_id for r in G.documents_identified(spark.createDataFrame(rows, DOC)).select("row.doc_id", "lang_id").collect()}
    assert got[500] == "en" and got[501] == "de"


def test_edges(spark):
    rows = [(1, None, "en", "h", "x", 1.0, 1), (2, "", "en", None, None, None, None), (3, " \n\t", None, "h", None, None, None), (4, "the cat and the dog went home", None, None, None, None, None), (None, "the cat and the dog", "en-US", "h", None, None, None),
            (5, "the " * 40000, "not a tag!", "h", None, None, None), (6, "the dog", "en", "h", None, None, None), (6, "the dog", "en", "h", None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    got = [(r.doc_id, r.lang_id, r.kept) for r in G.documents_identified(df).select("row.doc_id", "lang_id", "kept").collect()]
    assert len(got) == 8 and {(i, k) for i, la, k in got if la is None} == {(1, False), (2, False), (3, False)}
    out = G.keep_identified(df)
    assert out.columns == df.columns and out.count() == 5 and {r.lang for r in out.collect()} == {"en"}
    assert G.documents_identified(spark.createDataFrame([], DOC)).count() == 0


def test_address(spark):
    one = spark.createDataFrame([("https://Blog.Example.DE/x?y",), ("src0",), ("a.b.c",), ("",), (None,)], "u string")
    got = [tuple(r) for r in one.select(*G.address(F.col("u"))).collect()]
    assert got == [("blog.example.de", "example.de", "de"), ("src0", "src0", "src0"), ("a.b.c", "b.c", "c"), ("", "", ""), ("", "", "")]


def test_more_than_64_languages(spark):
    """Every declared language has a model, the rarest too."""
    letters = "abcdefghij"
    tags = [a + b for a in letters for b in letters][:70]
    rows = [(k * 10 + i, " ".join([f"{t}{t}k{t}", f"{t[::-1]}z{t}{t}"] * 6), t, f"http://{t}.example.org/") for k, t in enumerate(tags) for i in range(3 if k < 69 else 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {r.doc_id: (r.lang_id, r.kept) for r in G.identify(frame, F.col("text"), F.col("lang"), F.col("url")).select("row.doc_id", "lang_id", "kept").collect()}
    assert got == {i: (t, True) for i, _, t, _ in rows}


def test_sample_counts_copies_once(spark):
    """A language of a few texts in many copies is fitted on all of these, once each."""
    texts = {"en": ["the cat and the dog", "a house on the hill", "where is the river"], "de": ["der Hund und die Katze"]}
    few = spark.createDataFrame([(t, la) for la, ts in texts.items() for t in ts], "text string, lang string")
    many = spark.createDataFrame([(t, la) for la, ts in texts.items() for t in ts for _ in range(500)], "text string, lang string")
    assert (G.fit(many, 5).log == G.fit(few, 5).log).all()


def buckets(text):
    """Trigram buckets of a text, one by one."""
    raw = text.encode()
    if not raw:
        return []
    fold = lambda b: b + 32 if 65 <= b <= 90 else 0x20 if b in (9, 10, 11, 12, 13) else 0x30 if 48 <= b <= 57 else b
    raw = [0x20, *map(fold, raw), 0x20]
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 17 for i in range(len(raw) - 2)]


def plain(rows, sample):
    """Language, posterior and decision of each (text, declared, host), by plain loops over dictionaries; ``sample``: the texts to fit on."""
    langs = sorted({d for _, d, _ in rows if d})
    fitted = {la: {} for la in langs}
    for t, d in sample:
        for b in buckets(t):
            fitted[d][b] = fitted[d].get(b, 0) + 1
    size = {la: sum(fitted[la].values()) for la in langs}
    logp = lambda la, b: math.log((1 - G.NOISE) * (fitted[la].get(b, 0) + G.SMOOTH) / (size[la] + G.SMOOTH * G.BUCKETS) + G.NOISE / G.BUCKETS)
    mean, blank = [], []
    for t, _, _ in rows:
        g = buckets(t or "")
        mean.append({la: sum(logp(la, b) for b in g) / len(g) if g else 0.0 for la in langs} | {"n": len(g)})
        blank.append(not (t or "").strip(" \t\n\x0b\x0c\r"))
    top = [None if b else max(langs, key=lambda la: m[la]) for m, b in zip(mean, blank)]
    n, taught = len(langs), {t for t, _ in sample}
    agree = {la: {d: 0.5 + (5 * n if la == d else 0) for d in [*langs, "?"]} for la in langs}
    overall, host = dict.fromkeys(langs, 1.0), {}
    for (t, d, h), la in zip(rows, top):
        if la:
            overall[la] += 1
            host.setdefault(h, dict.fromkeys(langs, 0))[la] += 1
            if d and t not in taught:
                agree[la][d] += 1
    out = []
    for (t, d, h), la, m, b in zip(rows, top, mean, blank):
        score = {}
        for k in langs:
            own = {x: host.get(h, {}).get(x, 0) - (x == la) for x in langs}
            prior = (own[k] + G.KAPPA * overall[k] / sum(overall.values())) / (sum(own.values()) + G.KAPPA)
            prior = (own[k] + G.KAPPA * prior) / (sum(own.values()) + G.KAPPA)
            score[k] = m[k] * min(m["n"], G.TEXT_GRAMS) + math.log(prior) + (math.log(agree[k][d] / sum(agree[k].values())) if d else 0)
        best = max(langs, key=lambda k: score[k])
        sure = 1 / sum(math.exp(score[k] - score[best]) for k in langs)
        out.append((None, 0.0, False) if b else (best, sure, sure >= G.LEAST_POSTERIOR and max(m[k] for k in langs) > -math.log(G.BUCKETS) - 1))
    return out


@pytest.mark.parametrize("sample", [400, 8])
def test_posterior_against_brute_force(spark, sf, monkeypatch, sample):
    monkeypatch.setattr(G, "SAMPLE", sample)
    monkeypatch.setattr(G.fit, "__defaults__", (sample,))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.substring("text", 1, 600)).cache()
    got = [(r.text, r.lang, r.source, r.lang_id, r.posterior, r.kept) for r in G.documents_identified(docs, give_text=True).select("text", "row.lang", "row.source", "lang_id", "posterior", "kept").collect()]
    model = G.fit(docs, sample)
    chosen = docs.where(G.sampled(F.col("text"), G.primary(F.col("lang")), model.share)).select("text", G.primary(F.col("lang")).alias("lang")).distinct()
    want = plain([(t, d, s) for t, d, s, *_ in got], [tuple(r) for r in chosen.collect()])
    for (_, _, _, la, p, k), (wla, wp, wk) in zip(got, want):
        assert la == wla and abs(p - wp) < 1e-4 and k == wk


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "one and the same text", la, f"h{i}", None, None, None) for i, la in enumerate(("b" + x for x in "ba"))] + [(9, "one and the same text", None, None, None, None, None)]
    got = {r.doc_id: r.lang_id for r in G.documents_identified(spark.createDataFrame(rows, DOC)).select("row.doc_id", "lang_id").collect()}
    assert got[9] == "ba"


def test_pages(spark, sf):
    """Text without tags, the declared language of the markup and the address."""
    got = G.language_of_pages(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    said = pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("said"))
    assert got.count() == pages.count() and got.columns == ["page_id", "lang", "posterior", "kept"]
    assert got.join(said, "page_id").where("lang = said and kept").count() >= 0.9 * pages.count()
