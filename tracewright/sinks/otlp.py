"""OTLP payloads: spans by scope, metrics by name, as JSON built in Spark, and their delivery over HTTP."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spans as S

SCOPE, VERSION = "tracewright", "1.0"


def trace_id(command: str, start_ns: int, host: str) -> Column:
    """32 hexadecimal digits from the run's identity."""
    return F.left(F.sha2(F.lit(f"{command}:{start_ns}:{host}").cast("binary"), 256), F.lit(32))


def span_id(x: Column, otherwise: Column) -> Column:
    """16 hexadecimal digits of an unsigned decimal id; of the position where there is none."""
    number = F.when(x.rlike(r"^\d{1,20}$"), F.conv(x, 10, 16))
    return F.lower(F.lpad(F.coalesce(number, F.hex(otherwise)), 16, "0"))


def attribute(key: Column, value: Column) -> Column:
    """A typed attribute: whole number, number or text."""
    whole, real = value.try_cast("bigint"), value.try_cast("double")
    none = F.lit(None)
    typed = F.struct(
        F.when(whole.isNotNull(), whole.cast("string")).alias("intValue"), F.when(whole.isNull() & real.isNotNull(), real).otherwise(none.cast("double")).alias("doubleValue"),
        F.when(whole.isNull() & real.isNull(), value).alias("stringValue"),
    )
    return F.struct(key.alias("key"), typed.alias("value"))


def spans(trace: DataFrame, run: Column, epoch_offset_ns: int = 0) -> DataFrame:
    """category and a span of the payload for each row; parents that aren't in the trace are left out."""
    own = span_id(F.col("span_id"), F.col("seq"))
    parents = S.ids(trace).select(F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    rows = trace.join(parents, "parent_span_id", "left")
    tags = F.transform(F.map_entries("tags"), lambda e: attribute(F.concat(F.lit("tag."), e["key"]), e["value"]))
    fixed = [attribute(F.lit("category"), F.col("category"))]
    ids = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, attribute(F.lit(k), F.col(c).cast("string"))) for k, c in (("process.pid", "pid"), ("thread.id", "tid"))]
    attrs = F.concat(F.array(*fixed), F.array_compact(F.array(*ids)), F.coalesce(tags, F.array().cast("array<struct<key:string,value:struct<intValue:string,doubleValue:double,stringValue:string>>>")))
    start = F.col("start_ns") + epoch_offset_ns
    body = F.struct(
        run.alias("traceId"), own.alias("spanId"), F.when(F.col("known"), span_id(F.col("parent_span_id"), F.lit(0))).alias("parentSpanId"), F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("["), "category", F.lit("]"))).alias("name"),
        F.lit(1).alias("kind"), start.cast("string").alias("startTimeUnixNano"), (start + F.greatest("duration_ns", F.lit(0))).cast("string").alias("endTimeUnixNano"), attrs.alias("attributes"), F.struct(F.lit(1).alias("code")).alias("status"),
    )
    return rows.select("category", "seq", body.alias("span"))


def scope_spans(trace: DataFrame, run: Column, epoch_offset_ns: int = 0, batch: int = 1000) -> DataFrame:
    """category, part, payload: spans by scope in batches, so that no scope is gathered in one row."""
    rows = spans(trace, run, epoch_offset_ns).withColumn("part", F.floor(F.col("seq") / batch))
    by = rows.groupBy("category", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json("span").alias("j")))), lambda x: x["j"]).alias("spans"))
    scope = F.concat(F.lit('{"scope":{"name":"' + SCOPE + "."), "category", F.lit(f'","version":"{VERSION}"}},"spans":['), F.array_join("spans", ","), F.lit("]}"))
    return by.select("category", "part", scope.alias("payload"))


def traces_payload(trace: DataFrame, command: str, start_ns: int = 0, host: str = "unknown", epoch_offset_ns: int = 0) -> DataFrame:
    """payload: a resourceSpans document for each batch of a scope."""
    rows = scope_spans(trace, trace_id(command, start_ns, host), epoch_offset_ns)
    resource = F.to_json(F.struct(F.array(attribute(F.lit("service.name"), F.lit(command)), attribute(F.lit("host.name"), F.lit(host))).alias("attributes")))
    return rows.select("category", "part", F.concat(F.lit('{"resourceSpans":[{"resource":'), resource, F.lit(',"scopeSpans":['), "payload", F.lit("]}]}")).alias("payload"))


def metrics(counters: DataFrame, epoch_offset_ns: int = 0, batch: int = 1000) -> DataFrame:
    """name, part, payload: gauge points by counter, in batches, with the first unit that isn't empty."""
    unit = counters.where("unit is not null and unit <> ''").groupBy("name").agg(F.min_by("unit", "seq").alias("unit"))
    point = F.struct((F.col("timestamp_ns") + epoch_offset_ns).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    rows = counters.select("name", "seq", F.floor(F.col("seq") / batch).alias("part"), F.to_json(point).alias("j"))
    by = rows.groupBy("name", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "j"))), lambda x: x["j"]).alias("points"))
    head = F.to_json(F.struct("name", F.coalesce("unit", F.lit("")).alias("unit")))
    body = F.concat(F.expr("substring(h_, 1, length(h_) - 1)"), F.lit(',"gauge":{"dataPoints":['), F.array_join("points", ","), F.lit("]}}"))
    return by.join(unit, "name", "left").withColumn("h_", head).select("name", "part", body.alias("payload"))


def metrics_payload(counters: DataFrame, epoch_offset_ns: int = 0) -> DataFrame:
    """name, part, payload: a resourceMetrics document for each batch of a counter."""
    head, tail = f'{{"resourceMetrics":[{{"scopeMetrics":[{{"scope":{{"name":"{SCOPE}","version":"{VERSION}"}},"metrics":[', "]}]}]}"
    return metrics(counters, epoch_offset_ns).select("name", "part", F.concat(F.lit(head), "payload", F.lit(tail)).alias("payload"))


def _posted(batches: Iterator[pa.RecordBatch], url: str, timeout: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        status, error = [], []
        for body in batch.column(0).to_pylist():
            request = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": "application/json"}, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    status.append(answer.status)
                    error.append(None if answer.status in (200, 202) else f"HTTP {answer.status}")
            except (urllib.error.URLError, TimeoutError) as e:
                status.append(getattr(e, "code", None))
                error.append(str(getattr(e, "reason", e)))
        yield pa.RecordBatch.from_arrays([pa.array(status, pa.int32()), pa.array(error, pa.string())], ["status", "error"])


def send(payloads: DataFrame, endpoint: str, kind: str = "traces", timeout: float = 10.0) -> int:
    """POST each payload to ``endpoint``/v1/``kind`` from the executors; how many were taken, an error if any wasn't.

    A task that is run again sends its payloads again: receivers know spans by their ids.
    """
    url = f"{endpoint.rstrip('/')}/v1/{kind}"
    out = payloads.select("payload").mapInArrow(lambda it: _posted(it, url, timeout), "status int, error string")
    sent = out.agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.min("error").alias("error")).first()
    if sent.bad:
        raise RuntimeError(f"{sent.bad} of {sent.n} payloads were not taken by {url}: {sent.error}")
    return sent.n
