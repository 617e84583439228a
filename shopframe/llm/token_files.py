"""Token ids as binary files: one zstandard dictionary for all, every document compressed by itself.

Writing: a dictionary is trained on the serialized ids of a bounded sample (``train_documents`` rows with the smallest
hashes, ``train_chars`` characters of each; it only affects sizes). The documents are dealt into ranges of ascending
id, about ``part_bytes`` bytes of text each; ties of one id are dealt on by a hash of the text and the row's place, so
that an id or a text which a third of all rows share is split too. A task encodes its range in order and emits a file
whenever ``file_bytes`` of frames have gathered, so it holds one file and one batch of rows. Files are written with
Spark's own writer and commit protocol, so any store that Spark writes works and a repeated task leaves no second copy.

A file is::

    header   8 bytes b"TOKENS01", u32 part, u32 chunk, 32 bytes sha256 of the dictionary
    frames   one zstandard frame a document: its ids as little-endian unsigned 32-bit integers
    index    a row a document: i64 id, u8 whether it has one, u64 ids before it in the file, u64 offset, u32 size, u64 ids
    footer   u64 offset of the index, u64 documents, u64 ids, u32 crc32 of the index, 8 bytes b"TOKENS01", b"\\n"

Ordered by (part, chunk) the files hold the documents in ascending id. ``TokenFile`` reads single documents by their
offsets without touching other frames.

Defined results: a null or empty text is its end id alone; a null id is kept as null and comes last; rows that repeat
are documents each, one after the other; very long texts are one frame (and so, if need be, one large file); an empty
table gives a folder without token files and an empty result; extra columns are not read. Where the sample is too small
to train on, its ids themselves are the dictionary; an empty one gives an empty dictionary.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import land, ship_package
from .packing import VOCABULARY, encoder

MAGIC = b"TOKENS01"
HEADER = struct.Struct("<8sII32s")
FOOTER = struct.Struct("<QQQI8s")
ENTRY = np.dtype([("id", "<i8"), ("known", "u1"), ("start", "<u8"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u8")])
END_ID = 2
LEVEL = 3
PART_BYTES = 32 << 20
FILE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
TRAIN_DOCUMENTS = 2_000
TRAIN_CHARS = 8_192
PARTS_A_GROUP = 1_000


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for data like the samples; too few or too small ones are joined as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _zstd(dictionary: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class FileBuilder:
    """Bytes of one file, document by document."""

    def __init__(self, part: int, chunk: int, digest: bytes, compressor):
        self.out = io.BytesIO()
        self.out.write(HEADER.pack(MAGIC, part, chunk, digest))
        self.compressor, self.entries, self.tokens = compressor, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame, n = self.compressor.compress(ids), len(ids) // 4
        self.entries.append((doc_id or 0, doc_id is not None, self.tokens, self.out.tell(), len(frame), n))
        self.out.write(frame)
        self.tokens += n

    def size(self) -> int:
        return self.out.tell()

    def finish(self) -> bytes:
        at, index = self.out.tell(), np.array(self.entries, ENTRY).tobytes()
        self.out.write(index)
        self.out.write(FOOTER.pack(at, len(self.entries), self.tokens, zlib.crc32(index), MAGIC))
        return self.out.getvalue()


class TokenFile:
    """Documents of one file by place or id; ``source`` is a seekable binary file or the file's bytes."""

    def __init__(self, source, dictionary: bytes):
        self.source = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        magic, self.part, self.chunk, digest = HEADER.unpack(self._read(0, HEADER.size))
        end = self.source.seek(0, io.SEEK_END) - 1 - FOOTER.size
        at, n, self.tokens, check, last = FOOTER.unpack(self._read(max(end, 0), FOOTER.size))
        index = self._read(at, n * ENTRY.itemsize) if last == MAGIC and at <= end else b""
        if magic != MAGIC or last != MAGIC or zlib.crc32(index) != check:
            raise ValueError("not a whole token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("token file of another dictionary")
        self.index = np.frombuffer(index, ENTRY)
        self._unpack = zstandard.ZstdDecompressor(**_zstd(dictionary)).decompress

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, place: int) -> bytes:
        entry = self.index[place]
        out = self._unpack(self._read(int(entry["offset"]), int(entry["size"])))
        if len(out) != 4 * int(entry["n"]):
            raise ValueError(f"document {place} does not have its length")
        return out

    def places(self, doc_id: int) -> range:
        """The places of an id; ids ascend, null ones come last."""
        known = self.index["id"][:int(self.index["known"].sum())]
        return range(int(np.searchsorted(known, doc_id)), int(np.searchsorted(known, doc_id, side="right")))


def trained_dictionary(rows: DataFrame, n_rows: int, vocabulary: str, size: int = DICTIONARY_BYTES,
                       documents: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS) -> bytes:
    """A dictionary for the (id, text) rows, of which there are ``n_rows``. Only rows whose hash lies below a threshold
    for about twice the sample are compared, so that what one task merges does not grow with the table."""
    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        samples = [np.array(encode(t), "<u4").tobytes() for f in frames for t in f["text"] if t]
        yield pd.DataFrame({"dictionary": [dictionary_of(samples, size) if samples else b""]})

    share = min(1.0, 2 * documents / max(n_rows, 1))
    below = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    sample = (rows.select(F.xxhash64("id", "text").alias("h"), F.substring("text", 1, chars).alias("text"))
              .where(F.col("h") <= below).orderBy("h").limit(documents))
    # the sample is bounded, and so is the dictionary
    return b"".join(bytes(r.dictionary) for r in sample.coalesce(1).mapInPandas(train, "dictionary binary").collect())


def _write_binary(rows: DataFrame, path: str) -> None:
    """One file for each row's ``file``, followed by a newline."""
    rows.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID, part_bytes: int = PART_BYTES,
                      file_bytes: int = FILE_BYTES, level: int = LEVEL, **training) -> None:
    """Write the ids of all documents below ``path``/files in ascending order of the ids of the documents, and the
    dictionary below ``path``/dictionary."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    dictionary = trained_dictionary(rows, total["n"], vocabulary, **training)
    digest = hashlib.sha256(dictionary).digest()
    _write_binary(spark.createDataFrame([(bytearray(dictionary),)], "file binary").coalesce(1), f"{path}/dictionary")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        compressor = zstandard.ZstdCompressor(level=level, **_zstd(dictionary))
        part, chunk, file = TaskContext.get().partitionId(), 0, None
        for pdf in frames:
            for doc, text in zip(pdf["id"], pdf["text"]):
                file = file or FileBuilder(part, chunk, digest, compressor)
                file.add(None if pd.isna(doc) else int(doc), np.array([*encode(text), end_id], "<u4").tobytes())
                if file.size() >= file_bytes:
                    yield pd.DataFrame({"file": [file.finish()]})
                    chunk, file = chunk + 1, None
        if file:
            yield pd.DataFrame({"file": [file.finish()]})

    parts = max(1, math.ceil((total["bytes"] or 0) / part_bytes))
    order = [F.col("id").asc_nulls_last(), "hash", "place"]
    dealt = (rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
             .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    _write_binary(dealt.select("id", "text").mapInPandas(pack, "file binary"), f"{path}/files")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(_read_binary(spark, f"{path}/dictionary").first()["content"])[:-1]


DOCUMENT = "part int, chunk int, place int, doc_id long, start long, n_tokens long"


def _documents(spark: SparkSession, path: str, name: str, kind: str, value) -> DataFrame:
    """Every document of all files with its numbers in its file, and ``value`` of its ids."""
    ship_package(spark)
    dictionary = read_dictionary(spark, path)
    names = [c.split(" ")[0] for c in DOCUMENT.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                file = TokenFile(content, dictionary)
                for at in range(0, len(file), 1_000):
                    index = file.index[at:at + 1_000]
                    numbers = {"part": file.part, "chunk": file.chunk, "place": np.arange(at, at + len(index)),
                               "doc_id": pd.array(index["id"].astype("int64"), "Int64"),
                               "start": index["start"].astype("int64"), "n_tokens": index["n"].astype("int64")}
                    out = pd.DataFrame(numbers)
                    out.loc[index["known"] == 0, "doc_id"] = pd.NA
                    out[name] = [value(file.ids(i)) for i in range(at, at + len(index))]
                    yield out[[*names, name]]

    return _read_binary(spark, f"{path}/files").mapInPandas(read, f"{DOCUMENT}, {name} {kind}")


def with_global_start(documents: DataFrame) -> DataFrame:
    """``start`` counted from the first of all documents. Totals of files are added up inside groups of parts, and those
    of groups once more, so no task sees more than the files of a group or one row a group."""
    documents = land(documents, "token-documents")
    group = F.floor(F.col("part") / PARTS_A_GROUP).alias("group")
    files = documents.groupBy("part", "chunk", group).agg(F.sum("n_tokens").alias("n"))
    inside = files.withColumn("inside", F.coalesce(F.sum("n").over(
        Window.partitionBy("group").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = files.groupBy("group").agg(F.sum("n").alias("of_group")).select("group", F.coalesce(F.sum("of_group").over(
        Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    starts = inside.join(groups, "group").select("part", "chunk", (F.col("inside") + F.col("earlier")).alias("first"))
    return documents.join(starts, ["part", "chunk"]).withColumn("start", F.col("start") + F.col("first")).drop("first")


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, place, doc_id, start, n_tokens, ids) of every document of the files below ``path``; ``start``
    counts the ids before it in its file, ``ids`` are little-endian unsigned 32-bit integers."""
    return _documents(spark, path, "ids", "binary", lambda ids: ids)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``token_documents`` with the crc32 of the ids in place of them, and ``start`` over all files."""
    return with_global_start(_documents(spark, path, "ids_crc32", "long", zlib.crc32))


def fetch_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: only their frames are decompressed."""
    ship_package(spark)
    dictionary, wanted = read_dictionary(spark, path), sorted(set(doc_ids))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                file = TokenFile(content, dictionary)
                found = [(i, file.ids(place)) for i in wanted for place in file.places(i)]
                yield pd.DataFrame(found, columns=["doc_id", "ids"])

    return _read_binary(spark, f"{path}/files").mapInPandas(read, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` below ``path`` (default: a new folder in the shared one) and read the files back as digests."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    write_token_files(docs, path, **options)
    return token_digests(spark, path)
