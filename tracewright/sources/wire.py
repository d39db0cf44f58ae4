"""Hook records: span, inst, ctr, stk and pcsa lines.

``parse`` works on batch and streaming frames alike; ``spans`` and so on pick
one kind.  Lines that can't be read are kept by ``quarantine``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import hex_to_long
from ..schema import category, empty_tags
from .lines import sequenced

_INT, _REAL = r"-?\d{1,19}", r"(?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?(?:nan|inf|NaN|Infinity))"
RECORD = (
    rf"^(?:span:[^:]*:{_INT}:{_INT}:{_INT}:{_INT}:|inst:[^:]*:{_INT}:{_INT}:{_INT}:|ctr:[^:]*:{_INT}:{_INT}:[^:]*:{_REAL}(?::|$)"
    rf"|stk:{_INT}:{_INT}:{_INT}:|pcsa:{_INT}:{_INT}:[^:]*:[0-9a-fA-F]{{1,15}}:\d{{1,9}}:{_INT}\s*$)"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """value, seq: lines with an order of arrival, that of files and of lines in them."""
    return sequenced(spark, path)


def parse(lines: DataFrame) -> DataFrame:
    """Lines (value, and seq where there is one) with their kind and raw fields; ``ok`` says whether a reader takes them.

    One regular expression decides: a plain filter that comes before any field is cut out.
    """
    kind = F.split_part("value", F.lit(":"), F.lit(1))
    part = F.when(F.col("value").startswith("stk:"), F.split("value", ":", 5)).otherwise(F.split("value", ":", 7))
    ok = F.coalesce(F.col("value").rlike(RECORD), F.lit(False))
    return lines.select(*lines.columns, kind.alias("kind"), ok.alias("ok"), part.alias("p"))


def _of(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where((F.col("kind") == kind) & F.col("ok"))


def _p(i: int) -> Column:
    return F.try_element_at("p", F.lit(i))


def _long(i: int) -> Column:
    return _p(i).try_cast("bigint")


def tags(text: Column) -> Column:
    """``k=v,k=v`` as a map, the last of equal keys; parts without ``=`` are left out."""
    pairs = F.filter(F.split(text, ","), lambda x: x.contains("="))
    key = lambda x: F.split_part(x, F.lit("="), F.lit(1))
    value = lambda x: F.substring_index(x, "=", 1)
    entries = F.transform(pairs, lambda x: F.struct(key(x).alias("key"), F.substring(x, F.length(value(x)) + 2, F.length(x)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.when(text.isNull() | (text == ""), empty_tags()).otherwise(F.map_from_entries(last))


def spans(parsed: DataFrame, greedy_name: bool = False) -> DataFrame:
    """Spans; a name ends at its first colon, or with ``greedy_name`` at the last one before tags."""
    rows = _of(parsed, "span")
    rest = _p(7)
    if greedy_name:
        has = rest.rlike("^.*:[^:=,]+=")
        name = F.when(has, F.regexp_extract(rest, "^(.*):[^:=,]+=.*$", 1)).otherwise(rest)
        tail = F.when(has, F.regexp_extract(rest, "^.*:([^:=,]+=.*)$", 1)).otherwise(F.lit(""))
    else:
        name = F.split_part(rest, F.lit(":"), F.lit(1))
        tail = F.when(rest.contains(":"), F.substring(rest, F.length(name) + 2, F.length(rest))).otherwise(F.lit(""))
    out = rows.withColumn("t_", tags(tail))
    keep = [c for c in ("trace_id", "seq") if c in parsed.columns]
    return out.select(
        *keep, name.alias("name"), category(_p(2)).alias("category"), _long(5).alias("start_ns"), _long(6).alias("duration_ns"), (_long(5) + _long(6)).alias("end_ns"), _long(3).alias("pid"), _long(4).alias("tid"),
        F.map_filter("t_", lambda k, v: ~k.isin("sid", "psid")).alias("tags"), F.col("t_")["sid"].alias("span_id"), F.col("t_")["psid"].alias("parent_span_id"),
    )


def instants(parsed: DataFrame) -> DataFrame:
    keep = [c for c in ("trace_id", "seq") if c in parsed.columns]
    name = F.array_join(F.slice("p", 6, 2), ":")
    return _of(parsed, "inst").select(*keep, name.alias("name"), category(_p(2)).alias("category"), _long(5).alias("timestamp_ns"), _long(3).alias("pid"), _long(4).alias("tid"))


def counters(parsed: DataFrame) -> DataFrame:
    keep = [c for c in ("trace_id", "seq") if c in parsed.columns]
    return _of(parsed, "ctr").select(*keep, _p(5).alias("name"), category(_p(2)).alias("category"), _long(4).alias("timestamp_ns"), _p(6).try_cast("double").alias("value"), F.coalesce(_p(7), F.lit("")).alias("unit"), _long(3).alias("pid"))


def stacks(parsed: DataFrame) -> DataFrame:
    """pid, tid, start_ns, frames (innermost first)."""
    keep = [c for c in ("trace_id", "seq") if c in parsed.columns]
    return _of(parsed, "stk").select(*keep, _long(2).alias("pid"), _long(3).alias("tid"), _long(4).alias("start_ns"), F.filter(F.split(_p(5), ";"), lambda x: x != "").alias("frames"))


def pc_samples(parsed: DataFrame) -> DataFrame:
    return _of(parsed, "pcsa").select(_p(4).alias("func_name"), hex_to_long(_p(5)).alias("pc_offset"), _long(6).cast("int").alias("stall_reason"), _long(7).alias("count"))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that no reader takes."""
    return parsed.where(~F.col("ok") & (F.trim("value") != "")).select(*[c for c in ("trace_id", "seq") if c in parsed.columns], "value")


def attach(spans_: DataFrame, stacks_: DataFrame) -> DataFrame:
    """``spans_`` with stack_frames: a stack goes to the latest earlier span of its thread that began when it says."""
    w = Window.partitionBy("pid", "tid", "start_ns").orderBy("seq")
    until = F.lead("seq").over(w)
    rows = spans_.withColumn("until_", until)
    one = stacks_.select(*[F.col(c).alias(f"k_{c}") for c in ("pid", "tid", "start_ns", "seq", "frames")])
    on = (F.col("pid") == F.col("k_pid")) & (F.col("tid") == F.col("k_tid")) & (F.col("start_ns") == F.col("k_start_ns")) & (F.col("k_seq") > F.col("seq")) & (F.col("until_").isNull() | (F.col("k_seq") < F.col("until_")))
    got = rows.join(one, on).groupBy("seq").agg(F.max_by("k_frames", "k_seq").alias("stack_frames"))
    return spans_.join(got, "seq", "left").withColumn("stack_frames", F.coalesce("stack_frames", F.array().cast("array<string>")))


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of record files."""
    parsed = parse(read(spark, path))
    return {"spans": attach(spans(parsed), stacks(parsed)), "instants": instants(parsed), "counters": counters(parsed), "pc_samples": pc_samples(parsed), "quarantine": quarantine(parsed)}
