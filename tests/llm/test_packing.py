"""Packing: every id in one piece, gapless sequences, no padding; ids equal to the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
from llm_helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from shopframe.llm import packing as P


def check(rows, out, length):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    left = {}
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        left.setdefault(i, []).append(ids.tobytes())
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0
    for i, texts in left.items():
        pieces = sorted(by_doc.pop(i), key=lambda r: r.start)
        if len(texts) == 1:
            assert b"".join(bytes(r.ids) for r in pieces) == texts[0]
            assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
            assert {r.doc_tokens for r in pieces} == {len(texts[0]) // 4}
        else:
            assert sum(r.length for r in pieces) == sum(len(t) // 4 for t in texts)
    assert not by_doc
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        sizes = [r.length for r in pieces]
        assert [r.offset for r in pieces] == np.cumsum([0, *sizes])[:-1].tolist()
        total = sum(sizes)
        assert total == length or total < length and total & (total - 1) == 0
        assert {r.sequence_length for r in pieces} == {total}


def test_pieces_and_sequences(spark, edge_rows):
    rows = edge_rows + [(50, "a<|endoftext|>b"), (51, "<|endoftext|>"), (52, "é   \n\n\n  12345 don't")]
    for length, windows in ((1024, 64), (1000, 3), (1, 1)):
        use = rows if length > 1 else [r for r in rows if len(r[1] or "") < 100]
        check(use, P.pack_documents(documents(spark, use).repartition(3), length=length, open_windows=windows).collect(),
              length)


def test_few_sequences(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(0, 700)) for i in range(300)]
    out = P.pack_documents(documents(spark, rows).coalesce(1)).collect()
    tokens = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= tokens // 1024 + 10


def test_empty_table(spark):
    assert P.pack_documents(documents(spark, [(1, "x")]).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 16), st.integers(1, 5))
def test_packer_keeps_every_id(sizes, length, windows):
    packer = P.Packer(length, windows)
    for doc, n in enumerate(sizes):
        packer.add((doc, 0, np.arange(n), n))
        assert len(packer.windows) <= windows
    packer.finish()
    seen = sorted((doc, int(x)) for s in packer.done for doc, start, ids, _ in s for x in start + np.arange(len(ids)))
    assert seen == [(d, x) for d, n in enumerate(sizes) for x in range(n)]
    lengths = [sum(len(p[2]) for p in s) for s in packer.done]
    assert all(n == length or n < length and n & (n - 1) == 0 for n in lengths)
    assert zlib.crc32(b"") == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(P.VOCABULARY)
    encode, whole, rng = P.encoder(path), Tokenizer.from_file(path), random.Random(8)
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x4E00, 0x4E80),
                                       0x20, 0x0A, 0x2003, 0x1F600])) for _ in range(rng.randint(0, 60)))
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
