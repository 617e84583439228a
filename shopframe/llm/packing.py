"""Bounded-space online packing of tokenised documents into fixed-length training sequences.

Each task streams its rows and keeps at most ``open_windows`` windows with room. Whole windows are cut from a long
document at once; what remains goes into the open window it fills best. If it fits into none, the fullest window
takes as much of its head as it has room for and is emitted full, and the rest is placed again. At the end of its
rows the task merges the windows still open into full ones; the last part of that, shorter than a window, becomes
sequences whose lengths are powers of two, which need no padding. So memory is bounded by the open windows, no row
is shuffled, and a task that runs again after a lost executor gives the same sequences.

Defined results: a null or empty text is its separator alone; repeated rows are packed each; a null id is kept as
null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

SEPARATOR = 0
LENGTH = 1024
OPEN_WINDOWS = 64
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


@cache
def encoder(path: str):
    """text -> ids of a byte-level BPE vocabulary file of the tokenizers library, without special tokens.

    tiktoken runs the same merges several times as fast; a text that holds the string of one of the file's added
    tokens goes to the tokenizers library itself, which alone knows how the file treats them.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    whole = Tokenizer.from_file(path)
    added = [t["content"] for t in file.get("added_tokens", [])]
    shown = _byte_characters()
    ranks = {bytes(shown[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(a in text for a in added):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Packer:
    """Best-fit packing with a bounded number of open windows. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.open_windows = length, open_windows
        self.windows: list[tuple[int, list]] = []  # (used, pieces)
        self.done: list[list] = []  # emitted sequences, each a list of pieces

    @staticmethod
    def _cut(piece, at):
        doc, start, ids, total = piece
        return (doc, start, ids[:at], total), (doc, start + at, ids[at:], total)

    def add(self, piece) -> None:
        while len(piece[2]) >= self.length:
            head, piece = self._cut(piece, self.length)
            self.done.append([head])
        while n := len(piece[2]):
            room = [(self.length - used, i) for i, (used, _) in enumerate(self.windows)]
            best = min((r for r in room if r[0] >= n), default=None)
            if best:
                self._fill(best[1], piece)
                return
            if len(self.windows) < self.open_windows:
                self.windows.append((n, [piece]))
                return
            gap, i = min(room)
            head, piece = self._cut(piece, gap)
            self._fill(i, head)

    def _fill(self, i, piece) -> None:
        used, pieces = self.windows[i]
        used += len(piece[2])
        pieces.append(piece)
        if used == self.length:
            self.done.append(pieces)
            self.windows[i] = self.windows[-1]
            self.windows.pop()
        else:
            self.windows[i] = (used, pieces)

    def finish(self) -> None:
        """Merge the open windows; cut what is left into powers of two."""
        pieces = [p for _, ps in self.windows for p in ps]
        left = sum(used for used, _ in self.windows)
        self.windows = []
        while left:
            size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= size
            sequence = []
            while size:
                piece = pieces.pop(0)
                if len(piece[2]) > size:
                    piece, rest = self._cut(piece, size)
                    pieces.insert(0, rest)
                size -= len(piece[2])
                sequence.append(piece)
            self.done.append(sequence)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   open_windows: int = OPEN_WINDOWS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with the separator that ends each document), sequence_id, offset in the sequence, and the
    sequence's length, which is ``length`` or a smaller power of two. A sequence's pieces are gapless from offset 0.
    """
    if length < 1 or open_windows < 1:
        raise ValueError("length and open_windows must be positive")
    ship_package(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        packer = Packer(length, open_windows)
        number = TaskContext.get().partitionId() << 33

        def emitted():
            nonlocal number
            rows = []
            for sequence in packer.done:
                offset, size = 0, sum(len(p[2]) for p in sequence)
                for doc, start, ids, total in sequence:
                    rows.append((doc, start, len(ids), ids.tobytes(), total, number, offset, size))
                    offset += len(ids)
                number += 1
            packer.done = []
            return _frame(rows)

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                for doc, text in zip(part["doc_id"], part["text"]):
                    ids = np.array([*encode(text or ""), SEPARATOR], dtype="<u4")
                    packer.add((None if pd.isna(doc) else int(doc), 0, ids, len(ids)))
                yield emitted()
        packer.finish()
        yield emitted()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(pack, SCHEMA)


def _frame(rows) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"doc_id": "Int64"} | {c: "int64" for c in names if c not in ("doc_id", "ids")})
