"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words (A-Z lower-cased).  Of equal lines the
earliest - by (doc_id, line number) - stays, wherever the others are.  A line of
``LEAST_WORDS`` words or more also goes if an earlier line is within one word
edit (a word replaced, added or left out): below four words one edit would leave
less than three quarters of a line alike.  The bound is one edit at any length,
as a line has as many variants as there are ways to choose the deleted words.

The near join follows the deletion-neighbourhood scheme: every line emits the
hashes of all its variants with one word deleted, and its own.  Lines within
one edit share such a key: lines of equal length share the variant without the
replaced word *at the same place*; a line with a word left out is itself a
variant of the other.  So a group of one key needs no pairs: each member is
held against the group's earliest line, and pairs grow with the number of
variants, not with its square.  Edits are then verified on the words.

Only lines that can have a partner emit variants: two lines within one edit
agree in their first or their last half (counted for the longer one's length),
so the hashes of these halves are counted first.  That filter loses nothing.

Defined results: null text stays null, blank lines always stay (they belong to
the layout), rows with a null doc_id pass unchanged and take no part.  A document
is an id with a text: different texts under one id are different documents, in
order of a hash of the text; equal rows are one document, and each of them keeps
its lines.  An empty table gives no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import binary_column, materialize, release, slices, table, utf8

LEAST_WORDS = 4
_P = np.uint64(0x5851F42D4C957F2D)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
U64 = np.uint64
ROW, KEYS = ["doc_id", "text_hash"], "doc_id long, text_hash long"  # what names a document


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _P, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


class Lines:
    """The non-blank lines of some texts, with the hashes of their words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, _, at = K.words(data, offs)
        self.h = K.run_hashes(data, starts)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        before = breaks[starts]  # line feeds before each word
        new = np.ones(len(starts), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (before[1:] != before[:-1])
        self.first = np.flatnonzero(new)  # of each line: its first word
        self.doc = doc[self.first]
        self.number = (before[self.first] - breaks[offs[:-1]][self.doc]).astype(np.int32)
        self.size = np.diff(np.append(self.first, len(starts)))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running sums of word hash times power, by place from the front and from the back; powers."""
        place = np.arange(len(self.h)) - np.repeat(self.first, self.size)
        pw = _powers(int(self.size.max(initial=1)))
        with np.errstate(over="ignore"):
            front = np.concatenate([np.zeros(1, U64), np.cumsum(self.h * pw[place])])
            back = np.concatenate([np.zeros(1, U64), np.cumsum(self.h * pw[np.repeat(self.size, self.size) - 1 - place])])
        return front, back, pw


def _key(x: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(x + n.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt)).view(np.int64)


def _line_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = [*ROW, "line", "n_words", "h1", "h2", "keys"]
    for batch in batches:
        ids, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        data, offs = utf8(batch.column(2))
        for i, j in slices(offs):
            x = Lines(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            front, back, _ = x.sums()
            a, n = x.first, x.size
            h1 = _key(front[a + n] - front[a], n, 1)
            h2 = _key(back[a + n] - back[a], n, 2)
            long = np.flatnonzero(n >= least)
            la, ln = a[long], n[long]
            keys = np.empty((len(long), 4), np.int64)
            for c, longer in enumerate((ln, ln + 1)):
                half = longer // 2
                keys[:, 2 * c] = _key(front[la + half] - front[la], longer, 3)
                keys[:, 2 * c + 1] = _key(back[la + ln] - back[la + ln - (longer - half)], longer, 4)
            count = np.zeros(len(n), np.int64)
            count[long] = 4
            col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][x.doc]), pa.array(texts[i:j][x.doc]), pa.array(x.number), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2), col], names)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the chosen lines of each text."""
    for batch in batches:
        ids, texts, chosen = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
        data, offs = utf8(batch.column(2))
        for i, j in slices(offs):
            x = Lines(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            want = chosen.slice(i, j - i)
            want_doc = np.repeat(np.arange(j - i), np.asarray(want.value_lengths()))
            want_line = np.asarray(want.flatten())
            pick = np.flatnonzero(np.isin(x.doc * (1 << 32) + x.number, want_doc * (1 << 32) + want_line))
            size = x.size[pick]
            ends = np.concatenate([[0], np.cumsum(size)])
            h = x.h[np.arange(ends[-1]) + np.repeat(x.first[pick] - ends[:-1], size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i:j][x.doc[pick]]), pa.array(texts[i:j][x.doc[pick]]), pa.array(x.number[pick]), binary_column(np.frombuffer(h.tobytes(), np.uint8), 8 * ends)], [*ROW, "line", "words"]
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each line without its p-th word, and with all of them (p = -1)."""
    for batch in batches:
        raw, offs = utf8(batch.column(3))
        h, at = np.frombuffer(raw.tobytes(), U64), offs // 8
        n = np.diff(at)
        if not len(n):
            continue
        pw = _powers(int(n.max(initial=1)))
        line = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(h)) - at[:-1][line]
        with np.errstate(over="ignore"):
            c = np.concatenate([np.zeros(1, U64), np.cumsum(h * pw[place])])
            i = np.arange(len(h))
            start, end = at[:-1][line], at[1:][line]
            v = (c[i] - c[start]) + (c[end] - c[i + 1]) * _INV
            own = c[at[1:]] - c[at[:-1]]
        keys = np.concatenate([_key(v, n[line] - 1, 5), _key(own, n, 5)])
        who = np.concatenate([line, np.arange(len(n))])
        p = np.concatenate([place, np.full(len(n), -1)]).astype(np.int32)
        ids, texts, number = (np.asarray(batch.column(c)) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p), pa.array(ids[who]), pa.array(texts[who]), pa.array(number[who])], ["v", "p", *ROW, "line"])


def within_one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether one replaced, added or left out item at most makes one sequence the other."""
    if abs(len(x) - len(y)) > 1:
        return False
    k = min(len(x), len(y))
    differ = np.flatnonzero(x[:k] != y[:k])
    if len(x) == len(y):
        return len(differ) <= 1
    if not len(differ):
        return True
    a, b = (x, y) if len(x) < len(y) else (y, x)
    return bool((a[differ[0] :] == b[differ[0] + 1 :]).all())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one_edit(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(batch.column(3), batch.column(4))]
        where = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(where) for c in range(3)], [*ROW, "line"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "text", "n_lines", "n_kept"]
    for batch in batches:
        _, offs = utf8(batch.column(1))
        for i, j in slices(offs):
            out, lines, kept = [], [], []
            for text, stay in zip(batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)):
                text, stay = text.as_py(), set(stay.as_py() or ())
                parts = [] if text is None else text.split("\n")
                solid = [bool(p.strip(" \t\n\x0b\x0c\r")) for p in parts]
                keep = [p for k, p in enumerate(parts) if not solid[k] or k in stay]
                lines.append(sum(solid))
                kept.append(sum(1 for k, s in enumerate(solid) if s and k in stay))
                out.append(None if text is None else "\n".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(kept, pa.int64())], names)


def near_lines(texts: DataFrame, first: DataFrame) -> DataFrame:
    """Document and line of first occurrences that have an earlier line within one edit."""
    key = first.where("keys is not null and size(keys) > 0").select(*ROW, "line", F.explode("keys").alias("k"))
    shared = key.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    chosen = key.join(shared, "k", "left_semi").groupBy(*ROW).agg(F.collect_set("line").alias("lines"))
    words = texts.join(chosen, ROW).select(*ROW, "text", "lines").mapInArrow(_word_rows, f"{KEYS}, line int, words binary").dropDuplicates([*ROW, "line"])
    words = materialize(words, "line-words")
    variants = materialize(words.mapInArrow(_variants, f"v long, p int, {KEYS}, line int"), "line-variants")
    order = F.struct(*ROW, "line")
    # lines that differ in one word at the same place, against the earliest of them
    place = variants.where("p >= 0").groupBy("v", "p").agg(F.min(order).alias("e"), F.count("*").alias("n")).where("n > 1").drop("n")
    replaced = variants.join(place, ["v", "p"]).where(order > F.col("e")).select(*ROW, "line", "e")
    # lines that are others' variants, with a word more or less
    base = variants.groupBy("v").agg(F.min(F.when(F.col("p") < 0, order)).alias("x"), F.min(F.when(F.col("p") >= 0, order)).alias("y"))
    base = materialize(base.where("x is not null and y is not null"), "line-bases")
    longer = variants.where("p >= 0").join(base.select("v", "x"), "v").where(order > F.col("x")).select(*ROW, "line", F.col("x").alias("e"))
    shorter = base.where("y < x").select("x.*", F.col("y").alias("e"))
    pairs = replaced.unionByName(longer).unionByName(shorter).select(*ROW, "line", *[F.col(f"e.{c}").alias(f"e_{c}") for c in (*ROW, "line")]).distinct()
    w, e = words.withColumnRenamed("words", "w"), words.select(*[F.col(c).alias(f"e_{c}") for c in (*ROW, "line")], F.col("words").alias("u"))
    both = pairs.join(w, [*ROW, "line"]).join(e, ["e_doc_id", "e_text_hash", "e_line"]).select(*ROW, "line", "w", "u")
    out = materialize(both.mapInArrow(_verify, f"{KEYS}, line int").distinct(), "line-near")
    for x in (words, variants, base):
        release(x)
    return out


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, digest: bool = False) -> DataFrame:
    """``docs`` without repeated lines; with ``digest``: doc_id, n_lines, n_kept, n_near, text."""
    has_id = docs.where("doc_id is not null")
    text = F.col("text").cast("string")
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")]
    texts = has_id.select(*key)
    lines = texts.mapInArrow(lambda it: _line_rows(it, least_words), f"{KEYS}, line int, n_words int, h1 long, h2 long, keys array<long>")
    first = lines.groupBy("h1", "h2", "n_words").agg(F.min(F.struct(*ROW, "line", "keys")).alias("f"))
    first = materialize(first.select("f.*"), "line-first")
    near = near_lines(texts, first)
    stay = first.select(*ROW, "line").join(near, [*ROW, "line"], "left_anti")
    gone = near.groupBy(*ROW).agg(F.count("*").alias("n_near"))
    stay = stay.groupBy(*ROW).agg(F.collect_list("line").alias("stay"))
    info = stay.join(gone, ROW, "full")
    info = materialize(info, "line-stay")
    release(first)
    # other columns travel packed, so that their names can't clash
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*([] if digest else [F.col(f"`{c}`") for c in others]) or [F.lit(0)]).alias("packed")
    flat = has_id.select(*key, packed)
    joined = flat.join(info, ROW, "left").select(F.struct("doc_id", "n_near", "packed").alias("row"), "text", "stay")
    kind = dict(joined.dtypes)["row"]
    out = joined.mapInArrow(_rebuild, f"row {kind}, text string, n_lines long, n_kept long")
    if digest:
        return out.select("row.doc_id", "n_lines", "n_kept", F.coalesce("row.n_near", F.lit(0)).alias("n_near"), "text")
    source = {"doc_id": F.col("row.doc_id"), "text": F.col("text")}
    back = [source.get(c, F.col(f"row.packed.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes]
    out = out.where("n_lines = 0 or n_kept > 0").select(*back)
    return out.unionByName(docs.where("doc_id is null"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_lines", "n_kept", "n_near", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS raw,
    list_filter(regexp_split_to_array(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
o AS (SELECT *, array_to_string(ws, ' ') AS norm FROM l),
f AS (SELECT doc_id, line, ws, norm FROM o WHERE len(ws) > 0 QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) = 1),
v AS (
  SELECT doc_id, line, len(ws) AS n, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') AS v
  FROM (SELECT *, unnest(generate_series(1, len(ws))) AS p FROM f WHERE len(ws) >= 4)),
near AS (
  SELECT a.doc_id, a.line FROM v a JOIN v b ON a.v = b.v AND a.p = b.p AND (b.doc_id, b.line) < (a.doc_id, a.line)
  UNION SELECT a.doc_id, a.line FROM v a JOIN f b ON a.v = b.norm AND len(b.ws) >= 4 AND (b.doc_id, b.line) < (a.doc_id, a.line)
  UNION SELECT b.doc_id, b.line FROM v a JOIN f b ON a.v = b.norm AND len(b.ws) >= 4 AND (a.doc_id, a.line) < (b.doc_id, b.line)),
s AS (SELECT doc_id, line FROM f EXCEPT SELECT doc_id, line FROM near),
j AS (SELECT o.*, s.line IS NOT NULL AS stays FROM o LEFT JOIN s USING (doc_id, line)),
k AS (SELECT doc_id, count(*) AS n FROM near GROUP BY doc_id),
g AS (
  SELECT doc_id, CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n_lines, CAST(count(*) FILTER (stays) AS BIGINT) AS n_kept,
    md5(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (stays OR len(ws) = 0), '')) AS text_md5
  FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CAST(coalesce(k.n, 0) AS BIGINT) AS n_near, text_md5
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
