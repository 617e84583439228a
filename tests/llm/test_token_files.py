"""Token files: ids of the tokenizers library, exact round trip, single documents by offset, damaged files."""

import hashlib
import io
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import zstandard
from llm_helpers import documents

from shopframe.llm import token_files as T
from shopframe.llm.packing import VOCABULARY
from shopframe.session import scratch_path


@cache
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@cache
def ids_of(text):
    return np.array([*whole().encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.fixture(scope="module")
def rows(edge_rows):
    return [*edge_rows, (50, "a<|endoftext|>b"), (51, "<|endoftext|>"), (-3, "é  \n\n 12345 don't"), (-3, "tie"),
            *[(i, f"number {i} of many short texts, the same words again") for i in range(100, 900)], *[(8, "same")] * 300]


@pytest.fixture(scope="module")
def written(spark, rows):
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    T.write_token_files(documents(spark, rows).repartition(5), path, part_bytes=60_000, file_bytes=4_000, documents=400)
    return path


def test_every_document_comes_back(spark, rows, written):
    got = T.token_documents(spark, written).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted(
        (i is None, i or 0, ids_of(t)) for i, t in rows)
    assert len({(r.part, r.chunk) for r in got}) > 8 and len({r.part for r in got}) > 2
    order = sorted(got, key=lambda r: (r.part, r.chunk, r.place))
    ids = [(r.doc_id is None, r.doc_id or 0) for r in order]
    assert ids == sorted(ids)


def test_digests_count_from_the_first_document(spark, rows, written):
    got = sorted(T.token_digests(spark, written).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ids = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids) and len(got) == len(rows)
    expected = sorted((str(i), len(ids_of(t)) // 4, zlib.crc32(ids_of(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected


def test_one_document_without_the_others(spark, rows, written):
    got = T.fetch_documents(spark, written, [50, -3, 8, 10 ** 9]).collect()
    wanted = [(i, ids_of(t)) for i, t in rows if i in (50, -3, 8)]
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted(wanted)
    assert len(T.read_dictionary(spark, written)) > 256

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, size=-1):
            out = super().read(size)
            self.read_bytes += len(out)
            return out

    build = T.FileBuilder(0, 0, hashlib.sha256(b"").digest(), zstandard.ZstdCompressor())
    for i in range(200):
        build.add(i, np.random.default_rng(i).integers(0, 50_000, 500).astype("<u4").tobytes())
    data = build.finish() + b"\n"
    file = T.TokenFile(source := Counted(data), b"")
    assert file.ids(file.places(77)[0]) == np.random.default_rng(77).integers(0, 50_000, 500).astype("<u4").tobytes()
    assert source.read_bytes < len(data) / 10 and list(file.places(500)) == []
    for broken in (data[:-30], data[:60] + b"x" + data[61:], b"y" + data[1:], data[:-60] + b"z" + data[-59:]):
        with pytest.raises((ValueError, zstandard.ZstdError, struct.error)):
            damaged = T.TokenFile(broken, b"")
            for i in range(len(damaged)):
                damaged.ids(i)
    with pytest.raises(ValueError, match="dictionary"):
        T.TokenFile(data, b"another")


def test_dictionary_shortens_short_documents():
    samples = [ids_of(f"a license of the software number {i} without warranty of any kind") for i in range(500)]
    dictionary = T.dictionary_of(samples)
    plain = zstandard.ZstdCompressor(level=3)
    shared = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
    new = ids_of("a license of the software number 1234 without warranty of any kind")
    assert len(shared.compress(new)) < 0.7 * len(plain.compress(new))
    assert T.dictionary_of([b"abcd"]) == b"abcd" and T.dictionary_of([]) == b""


def test_empty_table_and_few_texts(spark):
    for rows in ([], [(1, None)], [(None, "x")]):
        out = T.round_trip(documents(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in out) == sorted(
            (str(i), 0, zlib.crc32(ids_of(t))) for i, t in rows)
