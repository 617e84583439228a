"""SentencePiece encoding and decoding as a shortest path through a weighted finite-state transducer.

A model file is compiled to
  * the normaliser: identity on characters, white space to the space symbol, a space symbol put first if the model
    asks for it, runs of spaces reduced if it asks for that (files with a compiled character map are refused);
  * the pieces: a trie whose final states emit a piece with its weight (the negative score);
  * byte fallback: an arc for every character that is no piece, which emits its bytes' pieces (or the unknown piece);
  * for a BPE model, which pieces may follow each other: two may if merging their joined text gives just these two.
    A path all of whose neighbours may follow each other is the merge result, and the only such path (to any
    position, so the first that arrives there is the shortest).
The input is composed with these (the states are its positions and, for BPE, the last piece), and the shortest path in
the tropical semiring, the smallest sum of weights, is taken; of equal ones that which starts its last piece first.

The input is cut at places that no piece can span, such as before a space symbol, and the shortest paths of short parts
are kept in a cache of bounded size.

Defined results: a null text gives null ids, an empty one no ids; null ids give a null text; ids outside the vocabulary
are an error; decoding replaces bytes that are no UTF-8; repeated rows, empty tables and extra columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CACHED_PARTS = 600_000
CACHED_PAIRS = 400_000
CACHED_LENGTH = 48


class PieceTransducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        if rules.precompiled_charsmap:
            raise ValueError("models with a compiled character map are not supported")
        if trainer.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a shortest path")
        self.bpe = trainer.model_type == BPE
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.escape = rules.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unknown = self.types.index(UNKNOWN)
        used = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.ids = used
        self.scores = [p.score for p in proto.pieces]
        lowest = min((self.scores[i] for i in used.values()), default=0.0)
        self.unknown_weight = UNKNOWN_PENALTY - lowest
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.steps: dict[int, list] = {}  # merges of each piece met so far
        self.pair_cache: dict[int, bool] = {}
        self.part_cache: dict[str, tuple[int, ...]] = {}
        self.older_parts: dict[str, tuple[int, ...]] = {}
        # a state of the trie: its arcs, the piece that it emits (or -1) and the piece's weight
        self.trie: tuple[dict, int, float] = ({}, -1, 0.0)
        for piece, i in used.items():
            if self.bpe and self._merges(piece)[0] != [piece]:
                continue  # merging never arrives at it
            arcs = self.trie[0]
            for c in piece[:-1]:
                arcs = arcs.setdefault(c, ({}, -1, 0.0))[0]
            arcs[piece[-1]] = (arcs.get(piece[-1], ({},))[0], i, -self.scores[i])
        self.parts = self._certain_cuts(used)

    @staticmethod
    def _certain_cuts(used) -> re.Pattern | None:
        """Pattern of the parts between places that no piece spans: before a space symbol, on both sides of a
        character of no piece, and before a sign that no piece holds behind a letter. None if a piece has a space
        symbol behind another character."""
        if any(SPACE in piece.lstrip(SPACE) for piece in used):
            return None
        known = {c for piece in used for c in piece} - {SPACE}
        letters = {c for c in known if c.isalpha() or c.isdecimal()}
        inner = {b for piece in used for a, b in zip(piece, piece[1:]) if a in letters and b not in letters}
        signs = known - letters - inner

        def any_of(chars):
            return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]" if chars else "(?!)"

        letter, sign, rest = any_of(letters), any_of(signs), any_of(inner)
        none = "[^" + "".join(re.escape(c) for c in sorted(known)) + SPACE + "]"
        return re.compile(f"{SPACE}*{sign}*{letter}++(?!{rest})|{SPACE}*{sign}++(?!{rest}|{letter})|"
                          f"{SPACE}*{any_of(known)}+|{SPACE}+|{none}")

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Merge the text's symbols, best score first, of equal ones the leftmost: what is left, and after each merge
        its score and the outermost symbols."""
        symbols, steps = list(text), [(0.0, text[:1], text[-1:])]
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return symbols, steps

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives just these two. Their own merges go on independently, so
        they are replayed side by side; the pieces join if at any time merging across is the best."""
        if a not in self.steps:
            self.steps[a] = self._merges(self.pieces[a])[1]
        if b not in self.steps:
            self.steps[b] = self._merges(self.pieces[b])[1]
        left, right = self.steps[a], self.steps[b]
        i = j = 0
        apart = True
        while apart:
            across = self.ids.get(left[i][2] + right[j][1])
            score_a = left[i + 1][0] if i + 1 < len(left) else None
            score_b = right[j + 1][0] if j + 1 < len(right) else None
            if across is not None:
                score = self.scores[across]
                apart = score_a is not None and score_a >= score or score_b is not None and score_b > score
            if score_a is None and score_b is None:
                break
            if score_b is None or score_a is not None and score_a >= score_b:
                i += 1
            else:
                j += 1
        if len(self.pair_cache) >= CACHED_PAIRS:
            self.pair_cache.clear()
        self.pair_cache[a << 24 | b] = apart
        return apart

    def _fallback(self, char: str) -> tuple[int, ...]:
        if self.bytes:
            return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def _shortest_path(self, part: str) -> tuple[int, ...]:
        n, first_arcs, bpe, pairs = len(part), self.trie[0], self.bpe, self.pair_cache
        weights: list = [None] * (n + 1)
        lasts = [-1] * (n + 1)  # last piece; -1 at the start and behind a fallback arc
        starts = [0] * (n + 1)  # where the last arc began
        weights[0] = 0.0
        for i in range(n):
            weight = weights[i]
            if weight is None:
                continue
            last, arcs, j = lasts[i], first_arcs, i
            while j < n and (state := arcs.get(part[j])) is not None:
                j += 1
                arcs, piece, cost = state
                if piece < 0:
                    continue
                now = weights[j]
                if now is None or not bpe and weight + cost < now:
                    if bpe and last >= 0:
                        known = pairs.get(last << 24 | piece)
                        if known is None:
                            known = self._may_follow(last, piece)
                        if not known:
                            continue
                    weights[j], lasts[j], starts[j] = weight + cost, piece, i
            if first_arcs.get(part[i], self.trie)[1] < 0:  # the character is no piece
                cost = weight + self.unknown_weight
                if weights[i + 1] is None or cost < weights[i + 1]:
                    weights[i + 1], lasts[i + 1], starts[i + 1] = cost, -1, i
        out: list[int] = []
        at = n
        while at:
            start = starts[at]
            out.extend((lasts[at],) if lasts[at] >= 0 else reversed(self._fallback(part[start])))
            at = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        text = self.normalised(text)
        if self.parts is None:
            return list(self._shortest_path(text))
        out: list[int] = []
        known = self.part_cache
        for part in self.parts.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = self.older_parts.get(part) or self._shortest_path(part)
                if len(part) <= CACHED_LENGTH:
                    if len(known) >= CACHED_PARTS:  # the parts that are not met again go with the older half
                        self.older_parts, self.part_cache = known, {}
                        known = self.part_cache
                    known[part] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def transducer(path: str) -> PieceTransducer:
    with open(path, "rb") as f:
        return PieceTransducer(f.read())


def with_piece_ids(rows: DataFrame, text_col: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``rows`` with the piece ids of ``text_col`` as an array<int> column ``out``."""
    ship_package(rows.sparkSession)
    path = model or public_tokenizers.path(MODEL)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(path)
        for texts in _slices(batches):
            yield pd.Series([None if t is None else np.array(fst.encode(t), np.int32) for t in texts], dtype=object)

    return rows.withColumn(out, encode(F.col(text_col)))


def with_decoded_text(rows: DataFrame, ids_col: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of the piece ids in ``ids_col`` as column ``out``."""
    ship_package(rows.sparkSession)
    path = model or public_tokenizers.path(MODEL)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(path)
        for lists in _slices(batches):
            yield pd.Series([None if x is None else fst.decode(x.tolist()) for x in lists], dtype=object)

    return rows.withColumn(out, decode(F.col(ids_col)))


def with_round_trip(rows: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with ``ids`` and ``decoded``, the piece ids of ``text_col`` and their text, in one pass. Columns of
    ``rows`` by these two names are replaced, all others stay."""
    ship_package(rows.sparkSession)
    path = model or public_tokenizers.path(MODEL)

    @F.pandas_udf("struct<ids array<int>, decoded string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fst = transducer(path)
        for texts in _slices(batches):
            ids = [None if t is None else fst.encode(t) for t in texts]
            yield pd.DataFrame({"ids": pd.Series([None if x is None else np.array(x, np.int32) for x in ids], dtype=object),
                                "decoded": pd.Series([None if x is None else fst.decode(x) for x in ids], dtype=object)})

    made = "__both"
    while made in rows.columns:
        made += "_"
    return rows.withColumn(made, both(F.col(text_col))).withColumns(
        {"ids": F.col(made)["ids"], "decoded": F.col(made)["decoded"]}).drop(made)


def _slices(batches: Iterator[pd.Series], size: int = 500) -> Iterator[pd.Series]:
    """Parts of the batches, so that only a few results are held at a time."""
    for batch in batches:
        for at in range(0, len(batch), size):
            yield batch.iloc[at:at + size]
