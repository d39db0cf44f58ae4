import gzip
import hashlib

import pytest

from tracewright.llm import warc as W

PAGE = "page_id long, url string, html string, refers_to string, content int"
BIG = "<p>" + "same payload " * 20 + "</p>"


def test_against_plain_rules(spark, tmp_path):
    rows = [(5, "http://a/ü\r\nx", BIG, None, None), (3, "http://b/", BIG, None, None), (9, None, BIG, "x", 1), (1, "u", "short", "x", 1), (2, "u", "short", "x", 1), (4, "u", None, None, None), (6, "u", "", "x", 1), (7, "u", "é" * 50, "x", 1), (8, "u", "é" * 50, "x", 1), (10, "u", "z" * 300_000, "x", 1)]
    df = spark.createDataFrame(rows, PAGE)
    archives = W.write_archives(df)
    got = {r.page_id: r for r in W.read_archives(archives).collect()}
    first = {}
    for i, _, h, *_ in sorted(rows):
        first.setdefault(h or "", i)
    for i, url, h, *_ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None, True)
    assert got[9].url is None and "\n" not in got[5].url
    W.to_files(archives, str(tmp_path / "w"))
    files = {r.page_id: tuple(r) for r in W.from_files(spark, str(tmp_path / "w")).collect()}
    assert files == {k: tuple(v) for k, v in got.items()}


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "u", BIG, None, None), (1, "u", BIG, None, None), (None, "u", "x", None, None)], PAGE)
    got = sorted((r.page_id or 0, r.record_type) for r in W.read_archives(W.write_archives(df)).collect())
    assert got == [(0, "response"), (1, "response"), (1, "response")]
    assert W.read_archives(W.write_archives(spark.createDataFrame([], PAGE))).count() == 0


def test_members_are_gzip():
    raw = W.info_record() + W.page_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    text = gzip.decompress(raw)
    assert text.count(b"WARC/1.1") == 2 and text.endswith(b"abc\r\n\r\n")
    pieces = [raw[i : i + 3] for i in range(0, len(raw), 3)]
    assert list(W.read_archive(iter(pieces))) == list(W.read_archive(raw)) and len(list(W.read_archive(raw))) == 1


def test_broken_archives():
    good = W.page_record(1, "u", b"abc" * 100, hashlib.sha256(b"abc" * 100).hexdigest(), None)
    with pytest.raises(W.WarcError):
        list(W.read_archive(good[:-20]))
    for block in (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabcdefg\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\nabc\r\n\r\n", b"nothing\r\n\r\n"):
        with pytest.raises(W.WarcError):
            list(W.read_archive(gzip.compress(block)))
    wrong = W.page_record(1, "u", b"abc" * 100, "0" * 64, None)
    assert [r[-1] for r in W.read_archive(wrong)] == [False]


def test_long_records_and_revisits_from_files(spark, tmp_path):
    """A file with a record of 30 MB is streamed; revisits are held against their responses."""
    import random

    text = random.Random(1).randbytes(15_000_000).hex()
    rows = [(1, "u", text, None, None), (2, "u", text, None, None), (3, "u", BIG, None, None), (4, "u", BIG, None, None)]
    records = W.read_archives(W.write_archives(spark.createDataFrame(rows[2:], PAGE)))
    W.to_files(W.write_archives(spark.createDataFrame(rows, PAGE)), str(tmp_path / "w"))
    got = sorted(tuple(r)[:5] for r in W.from_files(spark, str(tmp_path / "w")).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(1, 30_000_000, digest(text), "response", None), (2, 30_000_000, digest(text), "revisit", 1), (3, len(BIG), digest(BIG), "response", None), (4, len(BIG), digest(BIG), "revisit", 3)]
    assert W.unfounded(records).count() == 0 and W.unfounded(records.where("page_id <> 3")).first().page_id == 4
