import os
import random

import pytest

from tracewright.llm import unigram as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.MODEL), reason="the public vocabulary isn't there")
TEXTS = ["", " ", "  ", "a", "Hello  wörld", " lead and trail ", "line\nbreak\ttab", "▁marker▁", "日本語のテキスト", "😀😀 mixed ñ é ß", "<0x0A><s></s>", "\u00a0nbsp", "x" * 5000, "word " * 3000, "\x00\x01", "ü" * 3]
DOC = "doc_id long, text string, tokens string, n_tokens int"


@pytest.fixture(scope="module")
def model():
    return T.load()


def best_score(model, text):
    """Plain Viterbi over characters."""
    raw = (" " + text).encode()
    pieces = {p.replace("▁", " ").encode(): model.score[i] for i, p in enumerate(model.pieces) if i > 258}
    longest = max(map(len, pieces))
    best = [0.0] + [float("-inf")] * len(raw)
    for i in range(len(raw)):
        if best[i] == float("-inf") or raw[i] & 0xC0 == 0x80:
            continue
        w = 1
        while i + w < len(raw) and raw[i + w] & 0xC0 == 0x80:
            w += 1
        if raw[i : i + w] not in pieces:
            best[i + w] = max(best[i + w], best[i] + model.unknown)
        for n in range(1, min(longest, len(raw) - i) + 1):
            s = pieces.get(raw[i : i + n])
            if s is not None:
                best[i + n] = max(best[i + n], best[i] + s)
    return best[-1]


def score(model, text):
    ids, total, run = model.encode_text(text), 0.0, []
    raw = (" " + text).encode()
    at = 0
    for i in ids:
        n = int(model.ends[i + 1] - model.ends[i])
        if 3 <= i <= 258:
            if raw[at] & 0xC0 != 0x80:
                total += model.unknown
        else:
            total += model.score[i]
        at += n
    assert at == len(raw) and run == []
    return total


def test_round_trips(model):
    for t in TEXTS:
        assert model.decode_ids(model.encode_text(t)) == t


def test_best_scores(model):
    rng = random.Random(3)
    texts = [t for t in TEXTS if 0 < len(t) < 400] + ["".join(rng.choice("abc éß日 \n") for _ in range(60)) for _ in range(60)]
    for t in texts:
        assert abs(score(model, t) - best_score(model, t)) < 1e-6


def test_like_the_library(model):
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(T.MODEL, "rb").read())
    for i, p in enumerate(proto.pieces):
        if p.type in (1, 4):
            p.score = float(model.score[i])
    proto.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    total = lambda ids: sum(model.score[i] for i in ids)
    for t in ("the intention of this text is plain", "eine Zeile auf Deutsch", "une phrase en français", "y una frase"):
        a, b = lib.encode(t), model.encode_text(t)
        assert a == b or abs(total(a) - total(b)) < 1e-3


def test_trie():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    trie = T.DoubleArray(keys, list(range(6)))

    def find(k):
        s = 0
        for c in k:
            n = trie.base[s] + c + 1
            if trie.check[n] != s:
                return -1
            s = n
        return trie.value[s]

    assert [find(k) for k in keys] == list(range(6)) and find(b"z") == -1 and find(b"abd") == -1


def test_query(spark, model):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (None, "a b", None, None), (101, "same", "x", 1), (101, "same", "x", 1)]
    out = T.tokenize(spark.createDataFrame(rows, DOC)).cache()
    assert out.count() == len(rows) and out.where("not round_trip").count() == 0 and out.where("doc_id = 100").first().n_tokens == 0
    back = {r.doc_id: r.text for r in T.detokenize(out).where("doc_id < 100").collect()}
    assert back == dict(enumerate(TEXTS)) and out.where("doc_id = 3").first().tokens == model.encode_text("a")
    assert T.tokenize(spark.createDataFrame([], DOC)).count() == 0


def test_texts_without_spaces(model):
    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400)), "".join(rng.choice("abcdefgh0123XYZ+/") for _ in range(900)), "ab" * 700, "a" * 1001]
    for t in texts:
        assert model.decode_ids(model.encode_text(t)) == t
        assert score(model, t) == best_score(model, t)


def test_parts_of_long_texts_make_no_difference(model, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["die ", "漢字", "und", " aaaa", "b9", "  ", "\n", "é"]) for _ in range(1500)), "a" * 3000, "x y " * 900]
    whole = [model.encode_text(t) for t in texts]
    monkeypatch.setattr(T, "SLICE", 64)
    assert [model.encode_text(t) for t in texts] == whole


def test_time_is_linear_in_texts_without_spaces(model):
    import time

    for t in ("漢字仮名交じり文" * 100_000, "ab9" * 300_000):
        began = time.perf_counter()
        ids = model.encode_text(t)
        assert time.perf_counter() - began < 20
        assert model.decode_ids(ids) == t


def test_what_is_remembered_is_bounded(model, monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(60)]
    want = [model.encode_text(t) for t in texts]
    monkeypatch.setattr(T.Memory, "RUNS", 90)
    monkeypatch.setattr(model, "_memory", T.Memory())
    for t, w in zip(texts, want):
        assert model.encode_text(t) == w and len(model._memory.place) <= 90
    import pickle

    assert not pickle.loads(pickle.dumps(model))._memory.place
