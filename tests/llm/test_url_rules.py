from itertools import combinations
from math import ceil

from pyspark.sql import functions as F

from tracewright.llm import url_rules as U

PAGE = "page_id long, url string, items string, key int"
LABEL = "page_id long, bad boolean"


def test_hosts_and_paths(spark):
    rows = [("http://A.Example.COM/x/y?q#f", "a.example.com", "/x/y"), ("https://h?x/y", "h", ""), ("https://h#x", "h", ""), ("h://", "", ""), (None, "", ""), ("no scheme", "", ""), ("a://b://c/d", "b:", "//c/d"), ("x://ÄB.de/É?", "Äb.de", "/É"), ("://h/p", "h", "/p")]
    got = spark.createDataFrame([(u,) for u, _, _ in rows], "url string").select(U.host_of(F.col("url")), U.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [(h, p) for _, h, p in rows]


def test_fixed_rules(spark):
    rows = [("example.com", "/en/7x", "example.com/en/7", "allow"), ("a.example.com", "/en/8", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, None), ("example.net", "/de/80", "example.net/de/8", "block"),
            ("b.net", "/de/8", "net/de/", "allow"), ("notexample.net", "/de/8", "net/de/", "allow"), ("x.org", "/es", None, None), ("x.org", "/es/1", "org/es/", "block")]
    df = spark.createDataFrame([r[:2] for r in rows], "host string, path string")
    assert [tuple(r) for r in df.select(*U.fixed_rule(F.col("host"), F.col("path"))).collect()] == [r[2:] for r in rows]


def brute(rows, labels):
    """Blocked urls by all combinations of tokens."""
    tok = {i: t for i, t in rows}
    bad = [frozenset(tok[i]) for i, b in labels if b and tok.get(i)]
    every = [frozenset(tok[i]) for i, _ in labels if tok.get(i)]
    least = ceil(U.SUPPORT * len(bad))
    rules = set()
    for size in range(1, 1 + max(map(len, bad), default=0)):
        for c in {frozenset(c) for b in bad for c in combinations(sorted(b), size)}:
            n = sum(c <= b for b in bad)
            if n >= least and n >= U.CONFIDENCE * sum(c <= e for e in every):
                rules.add(c)
    return {i for i, t in rows if any(c <= frozenset(t) for c in rules)}


def test_against_brute_force(spark):
    rows = [(i, f"https://{('spammy', 'blog', 'www')[i % 3]}.site{i % 7}.org/{'ab'[i % 2]}/{i}?k{i % 4}=1") for i in range(300)]
    labels = [(i, i % 3 == 0 and i % 2 == 0 or i % 41 == 0) for i in range(0, 300, 2)]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], PAGE)
    tokens = [(r.page_id, r.t) for r in df.select("page_id", U.tokens(U.host_of(F.col("url")), U.path_of(F.col("url")), F.col("url")).alias("t")).collect()]
    got = {r.page_id for r in U.judge(df, spark.createDataFrame(labels, LABEL)).where("verdict = 'block' and rule is null").collect()}
    want = brute(tokens, labels)
    assert got == want and want


def test_rules_of_four_tokens(spark):
    """No three of the four tokens are sure enough."""
    marks = ["a", "b", "c", "d"]
    urls = ["http://x.org/" + "/".join(m for m in marks if m != out) + f"/{k}" for out in marks for k in range(40)] + [f"http://x.org/a/b/c/d/{k}" for k in range(30)]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], PAGE).selectExpr("page_id", "replace(url, 'x.org', 'x.com') AS url")
    labels = [(i, i >= 160) for i in range(len(urls))]
    got = U.judge(df, spark.createDataFrame(labels, LABEL)).where("verdict = 'block'")
    assert {r.page_id for r in got.collect()} == set(range(160, 190)) and got.first().mined_rule == "p:a p:b p:c p:d"


def test_deep_paths_and_copies(spark):
    """Forty segments that always come together are one class; copies of an address count once."""
    deep = "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    urls = [f"http://bad.net/{deep}/{k}" for k in range(20)] + [f"http://good.net/w{k}" for k in range(20)] + ["http://good.net/w1"] * 500 + [None, None]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], PAGE)
    labels = spark.createDataFrame([(i, i < 20) for i in range(540)], LABEL)
    got = {r.page_id for r in U.judge(df, labels).where("verdict = 'block'").collect()}
    assert got == set(range(20))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", None, 1), (3, "no scheme", None, 1), (None, "http://a.com/en/1", None, 1), (4, "http://a.com/en/1", "x", 1), (4, "http://a.com/en/1", "x", 1), (5, "http://" + "x" * 50000 + ".net/de/9", "x", 1)], PAGE)
    none = spark.createDataFrame([], LABEL)
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in U.judge(df, none).collect())
    assert got == [(0, "com/en/", "block"), (1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, "com/en/", "block"), (4, "com/en/", "block"), (5, "net/de/", "allow")]
    assert U.judge(spark.createDataFrame([], PAGE), none).count() == 0


def test_native_plan(spark, sf):
    plan = U.op5_url_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
