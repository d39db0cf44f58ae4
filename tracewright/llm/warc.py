"""WARC archives: a writer, and a sequential reader that checks what it reads.

Each record is one gzip member.  The reader feeds an incremental inflater piece
by piece, takes the header up to its blank line, then exactly Content-Length
bytes of block, hashing the payload as it passes; it holds one piece at a time,
whatever a record's length.  Digest, length and member boundaries are checked.

A page whose payload (of at least ``REVISIT_BYTES``) equals that of a page with
a smaller id becomes a revisit of it.  Digests are grouped before any payload
moves; payloads are shuffled only where the table of revisits is too large to
be broadcast.  Archives are rows of whole records (about ``SEGMENT`` bytes) in
a table of the shared folder, so that any executor can write and read them on
any file system; ``to_files`` lays them out as .warc.gz files on a mounted one,
``from_files`` streams archives of any size from wherever pyarrow can open them.
A revisit holds no payload; ``unfounded`` finds those whose response isn't there or differs.

Defined results: null html is an empty payload, null urls have no target URI,
line breaks in urls are escaped, equal rows give equal records, pages without an id
are records without one, an empty table gives no records, extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread, table

REVISIT_BYTES, SEGMENT, LEVEL, PIECE = 100, 4 << 20, 4, 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, digest_ok boolean"


class WarcError(ValueError):
    """An archive that breaks the framing rules."""


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()), z.compress(block), z.compress(b"\r\n\r\n"), z.flush()])


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def info_record() -> bytes:
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-page:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    return member(headers, http if refers_to is not None else http + payload)


def _pieces(data: bytes | Iterable[bytes]) -> Iterator[bytes]:
    if isinstance(data, (bytes, bytearray, memoryview)):
        view = memoryview(data)
        for i in range(0, len(view), PIECE):
            yield bytes(view[i : i + PIECE])
    else:
        yield from data


def members(data: bytes | Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member; a member must be read to its end before the next."""
    source, rest = _pieces(data), b""
    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        z = zlib.decompressobj(31)

        def inflate() -> Iterator[bytes]:
            nonlocal rest
            while not z.eof:
                if not rest:
                    rest = next(source, None)
                    if rest is None:
                        raise WarcError("the archive ends within a record")
                out = z.decompress(rest, PIECE)
                rest = z.unused_data if z.eof else z.unconsumed_tail
                if out:
                    yield out

        yield inflate()


def read_record(pieces: Iterator[bytes]) -> dict:
    """Header fields, length and digest of one record, read piece by piece."""
    head = b""
    for piece in pieces:
        head += piece
        if b"\r\n\r\n" in head:
            break
    raw, sep, body = head.partition(b"\r\n\r\n")
    lines = raw.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    left = int(fields["content-length"])
    http, payload_sha, seen = None if fields.get("content-type", "").startswith("application/http") else b"", hashlib.sha256(), 0
    held, tail = b"", b""

    def take(part: bytes) -> None:
        nonlocal http, held, seen
        if http is None:
            held += part
            if b"\r\n\r\n" not in held:
                return
            http, _, part = held.partition(b"\r\n\r\n")
        payload_sha.update(part)
        seen += len(part)

    while True:
        now, body = body[:left], body[left:]
        left -= len(now)
        if now:
            take(now)
        tail += body
        if len(tail) > 4:
            raise WarcError("the block is longer than its Content-Length")
        body = next(pieces, None)
        if body is None:
            break
    if left or tail != b"\r\n\r\n":
        raise WarcError("the block doesn't end where its Content-Length says")
    status = dict(x.split(": ", 1) for x in (http or b"").decode("latin-1").split("\r\n")[1:] if ": " in x)
    return fields | {"payload_seen": seen, "payload_sha256": payload_sha.hexdigest(), "http": status}


def read_archive(data: bytes | Iterable[bytes]) -> Iterator[tuple]:
    """A row of ``RESULT`` for every response and revisit of an archive."""
    page = lambda uri: int(uri[12:-1]) if uri[12:-1] else None
    for pieces in members(data):
        r = read_record(pieces)
        kind = r["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        said = r["warc-payload-digest"].removeprefix("sha256:")
        size = int(r["http"]["Content-Length"])
        ok = kind == "revisit" or (said == r["payload_sha256"] and size == r["payload_seen"])
        yield page(r["warc-record-id"]), size, said, kind, page(r["warc-refers-to"]) if kind == "revisit" else None, r.get("warc-target-uri"), ok


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size, n = [], 0, 0

    def segment() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([info_record() + b"".join(parts)], pa.binary())], ["n_records", "content"])

    for batch in batches:
        for k in range(batch.num_rows):
            page_id, url, html, digest, refers = (batch.column(c)[k].as_py() for c in range(5))
            parts.append(page_record(page_id, url, (html or "").encode(), digest, refers))
            size, n = size + len(parts[-1]), n + 1
            if size >= SEGMENT:
                yield segment()
                parts, size, n = [], 0, 0
    if parts:
        yield segment()


def _batches(rows: Iterator[tuple], size: int = 1000) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(kinds)], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield from _batches(read_archive(content.as_buffer().to_pybytes()))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, name = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            with files.open_input_stream(name, compression=None) as f:
                yield from _batches(read_archive(iter(lambda: f.read(PIECE), b"")))  # noqa: B023


def write_archives(pages: DataFrame) -> DataFrame:
    """Archive segments (n_records, content) of ``pages`` (page_id, url, html), stored in the shared folder."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    sums = base.select("page_id", F.octet_length("html").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    sums = materialize(sums.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest"), "warc-digests")
    first = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = sums.join(first, "digest").where("page_id <> refers_to").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    again = materialize(again.select("page_id", F.col("digest").alias("of"), "refers_to"), "warc-revisits")
    own = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    both = own.join(again, (own.page_id == again.page_id) & (own.digest == again.of), "left").select(own.page_id, "url", "html", "digest", "refers_to")
    return materialize(both.mapInArrow(_write, "n_records long, content binary"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every response and revisit of archives (content: whole gzip members)."""
    return archives.select("content").mapInArrow(_read, RESULT)


def to_files(archives: DataFrame, folder: str) -> None:
    """Lay archives out as .warc.gz files in a folder that driver and executors have mounted at the same place."""
    import os

    os.makedirs(folder, exist_ok=True)

    def save(rows) -> None:  # noqa: ANN001
        for row in rows:
            name = hashlib.sha256(row.content).hexdigest()[:24]
            with open(f"{folder}/.{name}", "wb") as f:
                f.write(row.content)
            os.replace(f"{folder}/.{name}", f"{folder}/{name}.warc.gz")  # a task that runs again writes the same file

    archives.select("content").foreachPartition(save)


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every response and revisit of the .warc.gz files in a folder; a file is read piece by piece, not loaded."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    return spread(paths, "path").mapInArrow(_read_files, RESULT)


def unfounded(records: DataFrame) -> DataFrame:
    """Revisits without a response of their digest among ``records``."""
    response = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest"], "left_anti").select(records.columns)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_archives(write_archives(table(spark, sf_dir, "pages")))
    checked = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload digest differs")))
    return out.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
