"""URL filters by association rules (native: Spark ML and DataFrame functions only).

Each address becomes a set of tokens (labels of its host, domain, suffix, path
segments with digits masked, names of query parameters).  Spark's FP-growth
mines the token combinations, of any number of tokens, that are frequent among
addresses labelled bad; those whose confidence over all labelled addresses
reaches ``CONFIDENCE`` and that no smaller rule already implies become rules.  An
inverted index finds the rules of an address: each rule is filed under its
rarest token, addresses look up their own tokens, and the rule's other tokens
are checked.

Tokens that occur in exactly the same labelled addresses (a host and its domain,
the segments of a fixed path) can't be told apart by any label: they form one
class, and mining and matching go by classes.  That changes no verdict, and keeps
the number of combinations from doubling with each of them.

Labels are those of the label table, whose ids are taken as page ids; an address
is bad if any label of a page that has it says so (quality 0 or toxic).

Before that, fixed rules decide: a rule (host, path) fits its host and all
subdomains if the address's path starts with the rule's; the longest wins.

Scale: mining and matching run over distinct addresses, one row each however
many pages share it.  Tables of classes and rules are broadcast after their size
was checked, and joined by shuffle beyond.

Defined results: null urls and urls without ``://`` have an empty host and
path, no tokens, no rule and the verdict allow; pages without an id are judged
like others but have no labels; without bad labels there are no mined rules; of
several rules the surest is named, of equally sure ones the last by its text; equal
rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SUPPORT, CONFIDENCE, BROADCAST_RULES = 0.02, 0.7, 100_000
# Verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of an address; empty if its host is."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1))))
    domain = F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    every = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.array(domain), parts, names)
    return F.when(F.size(labels) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _sized(small: DataFrame) -> DataFrame:
    """``small``, to be broadcast if it has few rows (counted)."""
    return F.broadcast(small) if small.count() <= BROADCAST_RULES else small


def classes(labelled: DataFrame, support: float) -> DataFrame:
    """token, cls, df: tokens frequent among bad addresses, and the class of those that occur in the same labelled addresses."""
    bad = labelled.where("bad").count()
    each = labelled.select(F.explode("items").alias("token"), "bad", F.xxhash64("url").alias("a"), F.xxhash64("url", F.lit(1)).alias("b"))
    seen = each.groupBy("token").agg(F.count("*").alias("df"), F.count_if("bad").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= F.ceil(F.lit(support) * bad))
    name = seen.groupBy("df", "a", "b").agg(F.min("token").alias("cls"))
    return materialize(seen.join(name, ["df", "a", "b"]).select("token", "cls", "df"), "url-classes")


def by_class(addresses: DataFrame, known: DataFrame) -> DataFrame:
    """url and the classes of its tokens, for addresses that have any."""
    each = addresses.select("url", F.explode("items").alias("token")).join(_sized(known.select("token", "cls")), "token")
    return each.groupBy("url").agg(F.collect_set("cls").alias("items"))


def mine(labelled: DataFrame, known: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_id, items, key, n_bad, confidence from distinct ``labelled`` addresses (url, items, bad) and the ``known`` classes."""
    from pyspark.ml.fpm import FPGrowth

    kind = {"rule_id": "long", "items": "array<string>", "n_items": "int", "key": "string", "n_bad": "long", "confidence": "double"}
    rows = labelled.select("url", "bad").join(by_class(labelled, known), "url", "left")
    rows = materialize(rows.select("url", "bad", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "url-classed")
    bad = rows.where("bad").select("items")
    if bad.limit(1).count() == 0:
        return labelled.where("false").select(*[F.lit(None).cast(t).alias(c) for c, t in kind.items()])
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(bad).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad"))
    sets = materialize(sets.withColumn("rule_id", F.xxhash64("items")), "url-sets")
    counts = known.groupBy(F.col("cls").alias("key")).agg(F.max("df").alias("df"))
    keyed = sets.select("rule_id", "items", "n_bad", F.explode("items").alias("key")).join(counts, "key")
    keyed = keyed.groupBy("rule_id").agg(F.first("items").alias("items"), F.first("n_bad").alias("n_bad"), F.min(F.struct("df", "key")).alias("k"))
    keyed = materialize(keyed.select("rule_id", "items", "n_bad", F.col("k.key").alias("key")), "url-keyed")
    total = look_up(rows, keyed).groupBy("rule_id").agg(F.count("*").alias("n_all"))
    rules = keyed.join(total, "rule_id").withColumn("confidence", F.col("n_bad") / F.col("n_all")).where(F.col("confidence") >= confidence)
    rules = materialize(rules.select("rule_id", "items", F.size("items").alias("n_items"), "key", F.col("n_bad").cast("long"), "confidence"), "url-rules")
    # a rule that a smaller one implies at no less confidence says nothing new
    short = rules.select(F.col("items").alias("part"), F.col("n_items").alias("m"), F.col("key").alias("key"), F.col("confidence").alias("c"), F.col("rule_id").alias("r"))
    wide = rules.select("rule_id", "items", "n_items", "confidence", F.explode("items").alias("key"))
    implied = wide.join(short, "key").where((F.col("m") < F.col("n_items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
    return materialize(rules.join(implied.select("rule_id").distinct(), "rule_id", "left_anti"), "url-pruned")


def look_up(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """url of ``addresses`` (url, items) with each rule that holds for it, through the inverted index."""
    slim = rules.select("rule_id", F.col("items").alias("part"), "key")
    probe = addresses.select("url", "items", F.explode("items").alias("key"))
    return probe.join(_sized(slim), "key").where(F.size(F.array_except("part", "items")) == 0).select("url", "rule_id")


def labels_of(labels: DataFrame) -> DataFrame:
    """page_id, bad from rows of ``labels`` (doc_id, quality, toxic)."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for each row of ``pages`` (page_id, url)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    taken = tokens(host, path, url).alias("items")
    given = rows.where("url is not null").join(labelled, "page_id").groupBy("url").agg(F.max("bad").alias("bad"))
    given = materialize(given.select("url", taken, "bad").where(F.size("items") > 0), "url-labelled")
    known = classes(given, SUPPORT)
    rules = mine(given, known)
    distinct = rows.where("url is not null").select("url").distinct().select("url", taken)
    hits = look_up(by_class(distinct, known), rules).join(_sized(rules.select("rule_id", "items", "confidence")), "rule_id")
    hits = hits.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("mined_rule"))).alias("hit"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    out = rows.join(hits, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "hit")
    method = F.when(F.col("hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("hit.mined_rule").alias("mined_rule"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labels_of(table(spark, sf_dir, "labels"))).drop("mined_rule")


_FOLD = f"'{UPPER}', '{LOWER}'"
ORACLE = rf"""
WITH u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_FOLD}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (
  SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
    list_filter(string_split(host, '.'), lambda x: x <> '') AS ls,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS ps,
    list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^#]*?\?([^#]*)', 1), ''), '&'), lambda x: x <> '') AS qs FROM u),
t AS (
  SELECT url, list_sort(list_distinct(list_concat(list_transform(ls, lambda x: 'h:' || x), ['d:' || array_to_string(ls[greatest(len(ls) - 1, 1):], '.')],
    list_transform(ps, lambda x: 'p:' || regexp_replace(translate(x, {_FOLD}), '[0-9]+', '#', 'g')), list_transform(qs, lambda x: 'q:' || split_part(x, '=', 1))))) AS items
  FROM (SELECT DISTINCT url, ls, ps, qs FROM f WHERE len(ls) > 0)),
lab AS (SELECT doc_id AS page_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
tl AS (SELECT t.url, items, bad FROM t JOIN (SELECT url, bool_or(bad) AS bad FROM f JOIN lab USING (page_id) GROUP BY url) USING (url)),
n AS (SELECT ceil({SUPPORT} * count(*)) AS least FROM tl WHERE bad),
fr AS (SELECT tok FROM (SELECT unnest(items) AS tok FROM tl WHERE bad) GROUP BY tok HAVING count(*) >= (SELECT least FROM n)),
fq AS (SELECT coalesce(list(tok), []) AS toks FROM fr),
k AS (SELECT t.url, bad, list_filter(t.items, lambda x: list_contains(toks, x)) AS items FROM t LEFT JOIN tl USING (url), fq),
c AS (SELECT url, bad, array_to_string(list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1), ' ') AS part FROM (SELECT *, unnest(generate_series(1, (1 << len(items)) - 1)) AS m FROM k)),
r AS (SELECT part FROM c WHERE bad IS NOT NULL GROUP BY part HAVING count(*) FILTER (bad) >= (SELECT least FROM n) AND count(*) FILTER (bad) >= {CONFIDENCE} * count(*)),
h AS (SELECT DISTINCT url FROM c SEMI JOIN r USING (part))
SELECT f.page_id, f.host, f.path, f.rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN h ON f.url = h.url
"""
