"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage keeps as Parquet in the shared folder and reads it again as the
next one's input, so a lost executor costs no more than running tasks.

1. language: documents whose language can't be told go; ``lang`` is the one found;
2. lines: repeated and nearly repeated lines go, documents left without any too;
3. near_duplicates: of each group of near-duplicate documents the first stays;
4. benchmark: documents that hold a test item go;
5. tokens: the rest is encoded as SentencePiece ids.

Rows with a null doc_id pass stages 2 to 4 as they are; null and blank texts
have no language and go in stage 1; extra columns stay until stage 5, whatever their
names.  Ties are the operators': the first language, the earliest line, the smallest
doc_id.  Of equal rows all stay that their lines leave anything of; different texts under
one doc_id are compared like others, but go together where one of them leaks or links to
a smaller id.  Texts of any length are processed whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, langid, line_dedup, minhash_forest, unigram
from tracewright.llm.common import materialize, release, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram.tokenize(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Language models and alignments aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
