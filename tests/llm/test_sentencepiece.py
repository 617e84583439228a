"""Piece ids against the library (BPE, and the same pieces as a unigram model), and round trips."""

import random

import public_tokenizers
import pytest
from llm_helpers import documents, prose

from shopframe.llm import sentencepiece_fst as T

sentencepiece = pytest.importorskip("sentencepiece")


def model():
    with open(public_tokenizers.path(T.MODEL), "rb") as f:
        return f.read()


def texts():
    rng = random.Random(51)
    pool = "abcXYZ  ▁\n\t.,é中文😀\x00ßñ'\"<s>0123 ²"
    out = ["", " ", "   ", "▁", "a" * 300, "ab" * 200, " " * 37, "don't.stop", "<s></s><unk><0x41>", prose(rng, 3000)]
    out += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(12))
                  for _ in range(300)]


def test_bpe_equals_the_library():
    lib, mine = sentencepiece.SentencePieceProcessor(model_proto=model()), T.PieceTransducer(model())
    for t in texts():
        ids = lib.encode(t)
        assert mine.encode(t) == ids
        assert mine.decode(ids) == lib.decode(ids)
        if "▁" not in t:
            assert mine.decode(ids) == t


def test_unigram_equals_the_library():
    """The same pieces with scores small enough for the library's single precision, as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(52)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model())
    proto.trainer_spec.model_type = T.UNIGRAM
    for p in proto.pieces:
        if p.type == T.NORMAL:
            p.score = -rng.randint(1, 4000) / 256 * max(1, len(p.piece)) ** 0.5
    data = proto.SerializeToString()
    lib, mine = sentencepiece.SentencePieceProcessor(model_proto=data), T.PieceTransducer(data)
    differ = [t for t in texts()[:300] if mine.encode(t) != lib.encode(t)]
    for t in differ:  # of equal weight, up to the library's rounding
        assert abs(sum(mine.scores[i] for i in mine.encode(t)) - sum(mine.scores[i] for i in lib.encode(t))) < 1e-2
    assert len(differ) < 6


def test_pairs_equal_plain_merging():
    mine, rng = T.PieceTransducer(model()), random.Random(53)
    ids = [i for i in mine.ids.values() if mine._merges(mine.pieces[i])[0] == [mine.pieces[i]]]
    for _ in range(20_000):
        a, b = rng.choice(ids[:900]), rng.choice(ids[:900])
        x, y = mine.pieces[a], mine.pieces[b]
        assert mine._may_follow(a, b) == (mine._merges(x + y)[0] == [x, y])


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHED_PARTS", 10)
    monkeypatch.setattr(T, "CACHED_PAIRS", 10)
    mine, lib = T.PieceTransducer(model()), sentencepiece.SentencePieceProcessor(model_proto=model())
    text = prose(random.Random(54), 500)
    assert mine.encode(text) == lib.encode(text) and len(mine.part_cache) <= 10 and len(mine.pair_cache) <= 10


def test_columns(spark, edge_rows):
    docs = documents(spark, edge_rows)
    out = T.with_decoded_text(T.with_piece_ids(docs), out="back").collect()
    both = T.with_round_trip(docs).collect()
    assert [(r.ids, r.back) for r in out] == [(r.ids, r.decoded) for r in both]
    assert len(out) == len(edge_rows) and all(r.back == r.text for r in out)
    assert [r.ids for r in out if r.text is None] == [None, None] and [r.ids for r in out if r.text == ""] == [[]]
    assert T.with_piece_ids(docs.limit(0)).collect() == []
