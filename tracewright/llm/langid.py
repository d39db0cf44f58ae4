"""Language identification by Bayesian evidence fusion.

Four sources of evidence are added up as log probabilities:

* text: a multinomial model of hashed byte trigrams for each language, fitted
  on at most ``SAMPLE`` distinct labelled texts of each language (chosen by hash); every declared language has one;
* the declared markup language, by how often declarations agree with texts, counted
  and smoothed over all documents but those whose texts the model was fitted on
  (these agree with their declaration because they were taught to);
* the address suffix, where it is that of a country with one main language;
* the host: how often each language occurs there, smoothed towards its domain,
  that towards the whole corpus.  These priors are grouped aggregates over all
  documents; each document's own count is taken out of its prior.

Trigrams overlap and repeat, so the text's mean log likelihood counts as if it
had ``TEXT_GRAMS`` independent ones at most.  A document is kept if the text
is no less likely in its language than even noise would be and the posterior reaches
``LEAST_POSTERIOR``.

Scale: texts are read twice and never shuffled while hosts fit a broadcast
(``BROADCAST_HOSTS``, counted first); beyond that, rows are joined by host and
Spark splits skewed hosts.  Models are tables of buckets by languages.

Defined results: null, empty or blank texts have no language (null) and aren't
kept; missing declarations, hosts and suffixes are no evidence; equal rows get
equal results; ties go to the language that sorts first; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialize, slices, table, utf8

SAMPLE, BUCKETS, SMOOTH, NOISE = 400, 1 << 15, 0.05, 0.05
TEXT_GRAMS, LEAST_POSTERIOR, KAPPA, BROADCAST_HOSTS = 200, 0.5, 20.0, 50_000
# Country suffixes with one main language.
SUFFIX = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "jp": "ja", "cn": "zh", "ru": "ru"}
SUFFIX_SHARE = 0.6


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts (with a space at either end; white space and digits folded) and where each begins."""
    lens = np.diff(offs)
    at = np.concatenate([[0], np.cumsum(np.where(lens > 0, lens + 2, 0))])
    text = np.full(at[-1], 0x20, np.uint32)
    full = lens > 0
    body = np.ones(at[-1], bool)
    body[at[:-1][full]] = False
    body[at[1:][full] - 1] = False
    fold = K.FOLD.copy()
    fold[K.SPACE] = 0x20
    fold[0x30:0x3A] = 0x30
    text[body] = fold[data]
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    g = (text[:-2] << np.uint32(16)) | (text[1:-1] << np.uint32(8)) | text[2:]
    g = (g * np.uint32(2654435761)) >> np.uint32(32 - 15)
    count = np.where(full, lens, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    where = np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], count)
    return g[where].astype(np.int64), begin


class Model:
    """Log probabilities of buckets (rows) in languages (columns); ``share``: which part of each one's texts it was fitted on."""

    def __init__(self, languages: list[str], counts: np.ndarray, share: dict[str, float] | None = None):
        self.languages, self.share = languages, share or {}
        self.log = np.empty(counts.shape, np.float32)
        for c in range(counts.shape[1]):
            p = (counts[:, c] + SMOOTH) / (counts[:, c].sum() + SMOOTH * BUCKETS)
            # a share of any text is none of its language: numbers, codes, names
            self.log[:, c] = np.log((1 - NOISE) * p + NOISE / BUCKETS)

    def mean(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihood of each text in each language, and its number of trigrams."""
        g, begin = grams(data, offs)
        n = np.diff(begin)
        out = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            for c in range(len(self.languages)):
                out[full, c] = np.add.reduceat(self.log[:, c][g].astype(np.float64), begin[:-1][full])
            out[full] /= n[full, None]
        return out, n


def _blank(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    solid = np.concatenate([[0], np.cumsum(~K.SPACE[data])])
    return solid[offs[1:]] == solid[offs[:-1]]


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = np.asarray(batch.column(0))
        data, offs = utf8(batch.column(1))
        for i, j in slices(offs):
            g, begin = grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            # as pairs that occur: a table of all would grow with the number of languages
            key, total = np.unique(g * n + np.repeat(lang[i:j], np.diff(begin)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // n).astype(np.int32)), pa.array((key % n).astype(np.int32)), pa.array(total.astype(np.int64))], ["bucket", "lang", "n"])


def primary(c: Column) -> Column:
    """The main part of a language tag, in lower case; null if it is none."""
    tag = F.lower(F.regexp_extract(F.trim(c.cast("string")), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(tag != "", tag)


def sampled(text: Column, lang: Column, share: dict[str, float]) -> Column:
    """Whether a text is among those a model is fitted on: a share of each language's, by hash."""
    if not share:
        return F.lit(False)
    part = F.create_map(*[F.lit(x) for k in sorted(share) for x in (k, share[k])])[lang]
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(1_000_003)) < part * 1_000_003, F.lit(False))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A text model from ``labelled`` (text, lang), on at most about ``sample`` distinct texts of each language."""
    spark = labelled.sparkSession
    rows = labelled.select(primary(F.col("lang")).alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    found = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model(["und"], np.zeros((BUCKETS, 1)))
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in found}
    index = F.create_map(*[F.lit(x) for k, v in enumerate(languages) for x in (v, k)])
    chosen = rows.where(sampled(F.col("text"), F.col("lang"), share)).distinct()
    chosen = chosen.select(index[F.col("lang")].alias("lang"), "text")
    n = len(languages)
    counts = chosen.mapInArrow(lambda it: _counted(it, n), "bucket int, lang int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.zeros((BUCKETS, n))
    table_[counts["bucket"], counts["lang"]] = counts["n"]
    return Model(languages, table_, share)


def _tops(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    model = shared.value
    for batch in batches:
        data, offs = utf8(batch.column(0))
        top = []
        for i, j in slices(offs):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            mean, _ = model.mean(part, at)
            top.append(np.where(_blank(part, at), -1, mean.argmax(axis=1)))
        top = np.concatenate(top) if top else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(top.astype(np.int32))], ["declared", "host", "domain", "taught", "top"])


def _fused(batches: Iterator[pa.RecordBatch], shared, give_text: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Row, text (if asked for), language, posterior, decision."""
    model, agree, overall = shared.value
    names = model.languages
    index = {k: i for i, k in enumerate(names)}
    n = len(names)
    noise = -np.log(BUCKETS) - 1
    for batch in batches:
        row, text, declared, suffix, own = batch.columns
        data, offs = utf8(text)
        mean, size, blank = np.zeros((len(offs) - 1, n)), np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, bool)
        for i, j in slices(offs):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            mean[i:j], size[i:j] = model.mean(part, at)
            blank[i:j] = _blank(part, at)
        top = mean.argmax(axis=1)
        score = mean * np.minimum(size, TEXT_GRAMS)[:, None]
        said = np.array([index.get(x, n) if x is not None else -1 for x in declared.to_pylist()], np.int64)
        score += np.where(said[:, None] >= 0, np.log(agree.T[said]), 0.0)
        for k, s in enumerate(suffix.to_pylist()):
            if SUFFIX.get(s) in index:
                hit = np.full(n, (1 - SUFFIX_SHARE) / max(1, n - 1))
                hit[index[SUFFIX[s]]] = SUFFIX_SHARE
                score[k] += np.log(hit)
        counts = np.zeros((len(top), 2, n))
        known = np.flatnonzero(np.asarray(own.is_valid()))
        if len(known):
            counts[known] = np.array([own[int(k)].as_py() for k in known], float).reshape(len(known), 2, n)
        counts[np.arange(len(top)), :, top] -= np.where(blank, 0, 1)[:, None]  # the document's own count
        counts = np.maximum(counts, 0)
        prior = (counts[:, 1] + KAPPA * overall) / (counts[:, 1].sum(axis=1, keepdims=True) + KAPPA)
        prior = (counts[:, 0] + KAPPA * prior) / (counts[:, 0].sum(axis=1, keepdims=True) + KAPPA)
        score += np.log(prior)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        sure = p[np.arange(len(best)), best]
        kept = ~blank & (sure >= LEAST_POSTERIOR) & (mean.max(axis=1, initial=-np.inf) > noise)
        lang = pa.array([None if b else names[k] for k, b in zip(best, blank)], pa.string())
        own_text, names_ = ([text], ["text"]) if give_text else ([], [])
        yield pa.RecordBatch.from_arrays([row, *own_text, lang, pa.array(np.where(blank, 0.0, sure)), pa.array(kept)], ["row", *names_, "lang_id", "posterior", "kept"])


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (the last one) of an address or bare host."""
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^(?:[^/?#]*?://)?([^/?#]*)", 1))
    labels = F.split(host, "\\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def identify(docs: DataFrame, text: Column, declared: Column, url: Column, model: Model | None = None, keep: list[str] | None = None, give_text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) as a column ``row``, the text if asked for, with lang_id, posterior and kept."""
    spark = docs.sparkSession
    host, domain, suffix = address(url)
    row = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    base = docs.select(F.struct(*(row or [F.lit(0)])).alias("row"), text.cast("string").alias("text"), primary(declared).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    model = model or fit(base.select("text", F.col("declared").alias("lang")))
    n = len(model.languages)
    shared = spark.sparkContext.broadcast(model)
    taught = sampled(F.col("text"), F.col("declared"), model.share).alias("taught")
    tops = base.select("text", "declared", "host", "domain", taught).mapInArrow(lambda it: _tops(it, shared), "declared string, host string, domain string, taught boolean, top int")
    counted = tops.where("top >= 0").groupBy("host", "domain", "declared", "taught", "top").agg(F.count("*").alias("n"))
    counted = materialize(counted, "lang-counts")
    shared.destroy()
    agree = np.full((n, n + 1), 0.5)  # language of the text, declared language (the last: any other)
    agree[np.arange(n), np.arange(n)] += 5 * n
    index = {k: i for i, k in enumerate(model.languages)}
    known = F.when(F.col("declared").isin(model.languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("?"))
    overall = np.ones(n)
    for r in counted.groupBy(known.alias("declared"), "taught", "top").agg(F.sum("n").alias("n")).collect():
        overall[r.top] += r.n
        if r.declared is not None and not r.taught:
            agree[r.top, index.get(r.declared, n)] += r.n
    agree /= agree.sum(axis=1, keepdims=True)
    overall /= overall.sum()

    def by(*k: str) -> DataFrame:
        each = counted.groupBy(*k, "top").agg(F.sum("n").alias("n")).groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("top", "n"))).alias("m"))
        return each.select(*k, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("c"))

    hosts = by("host", "domain").withColumnRenamed("c", "hc").join(by("domain").withColumnRenamed("c", "dc"), "domain")
    hosts = hosts.select("host", F.concat("hc", "dc").alias("own"))
    if hosts.count() * max(n, 64) <= BROADCAST_HOSTS * 64:  # each host has two counts a language
        hosts = F.broadcast(hosts)
    everything = spark.sparkContext.broadcast((model, agree, overall))
    joined = base.join(hosts, "host", "left").select("row", "text", "declared", "suffix", "own")
    kind = dict(joined.dtypes)["row"]
    return joined.mapInArrow(lambda it: _fused(it, everything, give_text), f"row {kind}, {'text string, ' if give_text else ''}lang_id string, posterior double, kept boolean")


def documents_identified(docs: DataFrame, give_text: bool = False) -> DataFrame:
    """``identify`` for documents; their texts, which are large, are not in ``row``."""
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"), keep=[c for c in docs.columns if c != "text"], give_text=give_text)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language can't be told; their lang is the one found."""
    out = documents_identified(docs, give_text=True).where("kept")
    source = {"lang": F.col("lang_id"), "text": F.col("text")}
    return out.select(*[source.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents_identified(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("lang_id").alias("lang"), F.col("row.lang").alias("declared"), "posterior", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of web pages: text without tags, the html element's lang, the page's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    said = F.regexp_extract(F.col("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    out = identify(pages, F.regexp_replace(bare, r"&[A-Za-z0-9#]+;", " "), said, F.col("url"), keep=["page_id"])
    return out.select("row.page_id", F.col("lang_id").alias("lang"), "posterior", "kept")
