"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, html_main, langid, line_dedup, minhash_forest, sharding, unigram, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": embedding_dedup.op1_nn_descent,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language": langid.op3_language,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_unigram": unigram.op6_unigram,
    "op7_minhash_forest": minhash_forest.op7_minhash_forest,
    "op8_virtual_slots": sharding.op8_virtual_slots,
    "op9_html_main": html_main.op9_html_main,
    "op10_warc": warc.op10_warc,
    "language_of_pages": langid.language_of_pages,
}

ORACLES: dict[str, str] = {
    "op1_nn_descent": embedding_dedup.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_url_rules": url_rules.ORACLE,
    "op7_minhash_forest": minhash_forest.ORACLE,
    "op10_warc": warc.ORACLE,
}
