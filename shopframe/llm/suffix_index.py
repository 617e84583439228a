"""Exact long-match removal with a logarithmic family of sparse suffix arrays.

Sampled suffixes. Of every ``length``-byte string of a document, the GRAM-byte string in it with the smallest hash
(the first, if several) is its anchor; equal strings have their anchor at the same place. A suffix array holds the
suffixes that start at anchors, ordered by their first eight bytes and then by a fingerprint of their first GRAM
bytes. Two places share a ``length``-byte string only if their anchors are equal in this order, so an array of about
one suffix in seventy bytes finds all matches.

Index. Documents come in batches. Each batch gets its suffix array, which is merge-scanned (a join on the sort key)
against every level of the index for anchors that stand there too; then the array becomes a level of its own. Levels
that have absorbed equally many batches are merged, so n batches leave log(n) levels and every suffix is rewritten
log(n) times.

Verification. Around each matching anchor stands its context, the union of the strings that have this anchor. Equal
contexts (same anchor, same 64-bit hash) match as a whole. For anchors with several contexts, one occurrence of each is
looked at closer. Its strings are taken in blocks of BLOCK starts at fixed distances from the anchor. The bytes that all
strings of a block share (its core) must match another block's for any of them to match; if the bytes of the whole
block match (its hull, by a 128-bit hash), all of them do; where only cores match, every string is compared by a 128-bit
hash. This is linear in the text: no pairs of occurrences are formed, however often a passage repeats.

Defined results: a null text counts as empty; texts shorter than ``length`` bytes lose nothing; of rows that repeat a
text each is an occurrence of its own, so all of them lose it; null ids are kept; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, ship_package, with_document_key

LENGTH = 200
GRAM = 64
SLICE = 1 << 20  # strings that are looked at together
BATCHES = 4
BLOCK = 16
STRETCH = 1 << 13
KEY = ["k1", "k2"]
HULL = ["hull1", "hull2"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place, by doubling a polynomial."""
    h = _mixed(np.arange(1, 257, dtype=np.uint64))[raw]
    base, step = 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    return _mixed(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(texts: list[bytes], length: int = LENGTH, size: int = SLICE) -> pd.DataFrame:
    """Anchors of all ``length``-byte strings of the texts: doc (index), at (start of the first string with this
    anchor), n (how many start in a row from there), left (bytes from ``at`` to the anchor), k1, k2 (place in the suffix
    order), context (hash)."""
    whole = b"".join(texts)
    raw = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - np.array([len(t) for t in texts])
    place_bits = np.uint64((size + length).bit_length())
    mask = np.uint64((1 << int(place_bits)) - 1)
    found = []
    for at in range(0, max(len(raw) - length + 1, 0), size):
        part = raw[at:at + size + length - 1]
        grams = _gram_hashes(part)
        places = np.arange(len(grams), dtype=np.uint64)
        low = _sliding_min((grams & ~mask) | places, length - GRAM + 1)
        chosen = (low & mask).astype(np.int64)
        starts = np.arange(at, at + len(chosen))
        doc = np.searchsorted(ends, starts, "right")
        inside = starts + length <= ends[doc]
        new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
        new[1:] |= inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(chosen)]))
        first, last = first[inside[first]], last[inside[first]]
        if not len(first):
            continue
        anchor = chosen[first]
        eight = np.lib.stride_tricks.sliding_window_view(part, 8)[anchor]
        k1 = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(whole[a:b]) for a, b in zip((first + at).tolist(),
                                                                  (last + at + length - 1).tolist())),
                              np.uint64, len(first))
        found.append(pd.DataFrame({
            "doc": doc[first], "at": first + at - begins[doc[first]], "n": last - first, "left": anchor - first,
            "k1": k1.view(np.int64),
            "k2": grams[anchor].view(np.int64), "context": context.view(np.int64)}))
    columns = ["doc", "at", "n", "left", "k1", "k2", "context"]
    return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})


class SuffixIndex:
    """Logarithmic family of suffix arrays: DataFrames (k1, k2, places), each with one row per distinct anchor."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (batches absorbed, suffix array), largest first

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index the suffixes (k1, k2, ...) of a new batch; returns the anchors that stand in it and anywhere else,
        in the batch itself or in an earlier one."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy(*KEY).agg(F.sum("places").alias("places"))
            self.levels.append((n + m, self._array(merged)))
        array = self._array(suffixes.groupBy(*KEY).agg(F.count("*").alias("places")))
        matches = array.where("places > 1").select(*KEY)
        for _, level in self.levels:
            matches = matches.unionByName(array.select(*KEY).join(level.select(*KEY), KEY))
        found = land(matches.distinct(), "suffix-matches")
        self.levels.append((1, array))
        return found

    @staticmethod
    def _array(suffixes: DataFrame) -> DataFrame:
        return land(suffixes.sortWithinPartitions(*KEY), "suffix-array")


def _suffixes(docs: DataFrame, length: int, batches: int) -> DataFrame:
    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = anchors([t.encode("utf-8") for t in pdf["text"]], length)
            doc = found.pop("doc").to_numpy(np.int64)
            for name in ("c", "k", "batch"):
                found.insert(0, name, pdf[name].to_numpy(np.int64)[doc])
            yield found

    source = docs.select(F.pmod(F.xxhash64("__k", "__c"), F.lit(batches)).alias("batch"), F.col("__k").alias("k"),
                         F.col("__c").alias("c"), F.coalesce("__text", F.lit("")).alias("text"))
    return source.mapInPandas(
        sample, "batch long, k long, c long, at long, n long, left long, k1 long, k2 long, context long").withColumns(
        {"batch": F.col("batch").cast("int"), "at": F.col("at").cast("int")}
        | {x: F.col(x).cast("short") for x in ("n", "left")})


def _block_ranges(n: int, left: int) -> Iterator[tuple[int, int, int]]:
    """(block, first, last) of the strings 0 to n - 1 of a context, cut where their distance to the anchor is a
    multiple of BLOCK."""
    last = n - 1
    while last >= 0:
        block = (left - last) // BLOCK
        first = max(0, left - block * BLOCK - BLOCK + 1)
        yield block, first, last
        last = first - 1


def _blocks(pieces: DataFrame, length: int) -> DataFrame:
    """(k2, context, first, last, core, hull1, hull2) of the blocks of ``pieces(k2, context, left, n, piece)``."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows, hulls = [], []
            for k2, context, left, n, piece in zip(*(pdf[c] for c in ("k2", "context", "left", "n", "piece"))):
                for block, first, last in _block_ranges(n, left):
                    core_at, core_end = left - block * BLOCK, left - block * BLOCK - BLOCK + 1 + length
                    core = xxhash.xxh3_64_intdigest(piece[core_at:core_end], block & 0xFF)
                    hulls.append(xxhash.xxh3_128_digest(piece[first:last + length], block << 16 | left - last))
                    rows.append((k2, context, first, last, core))
            halves = np.frombuffer(b"".join(hulls), ">i8").reshape(-1, 2).astype(np.int64)
            out = pd.DataFrame(rows, columns=["k2", "context", "first", "last", "core"])
            out["core"] = out["core"].to_numpy(np.uint64).view(np.int64)
            yield out.assign(hull1=halves[:, 0], hull2=halves[:, 1])

    return pieces.mapInPandas(cut, "k2 long, context long, first int, last int, core long, hull1 long, hull2 long")


def _strings(blocks: DataFrame, length: int) -> DataFrame:
    """(w1, w2, hull1, hull2, i): 128-bit hash of every string of ``blocks(hull1, hull2, first, last, piece)``."""
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for pdf in frames:
            first, last = pdf["first"].to_numpy(), pdf["last"].to_numpy()
            joined = b"".join(digest(p[i:i + length]) for p, a, b in zip(pdf["piece"], first.tolist(), last.tolist())
                              for i in range(a, b + 1))
            halves = np.frombuffer(joined, ">i8").reshape(-1, 2).astype(np.int64)
            counts = last - first + 1
            row = np.repeat(np.arange(len(pdf)), counts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pd.DataFrame({"w1": halves[:, 0], "w2": halves[:, 1], "i": number}
                               | {c: pdf[c].to_numpy(np.int64)[row] for c in HULL})

    return blocks.mapInPandas(each, "w1 long, w2 long, i int, hull1 long, hull2 long")


def _partial_matches(classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(k2, context, first, last) runs of strings that stand in several contexts of one anchor."""
    several = classes.groupBy(*KEY).agg(F.count("*").alias("contexts")).where("contexts > 1").select(*KEY)
    spans = (classes.join(several, KEY)
             .groupBy(F.col("sample.k").alias("k"), F.col("sample.c").alias("c"))
             .agg(F.collect_list(F.struct("k2", "context", "sample.at", "sample.n", "sample.left")).alias("spans")))
    source = docs.select(F.col("__k").alias("k"), F.col("__c").alias("c"), F.encode("__text", "UTF-8").alias("raw"))
    pieces = land(source.join(spans, ["k", "c"]).dropDuplicates(["k", "c"])
                  .select(F.explode("spans").alias("s"), "raw")
                  .select("s.k2", "s.context", "s.n", "s.left",
                          F.substring("raw", F.col("s.at") + 1, F.col("s.n").cast("int") + (length - 1)).alias("piece")),
                  "contexts-bytes")
    blocks = land(_blocks(pieces, length), "blocks")
    hull = F.struct(*HULL)
    cores = (blocks.groupBy("core").agg(F.count("*").alias("n"), F.min(hull).alias("low"), F.max(hull).alias("high"))
             .where("n > 1").select("core", (F.col("low") != F.col("high")).alias("differ")))
    met = land(blocks.join(cores, "core"), "matching-cores")
    whole = (met.groupBy(*HULL).agg(F.count("*").alias("n")).where("n > 1").select(*HULL)
             .join(met, HULL).select("k2", "context", "first", "last"))
    samples = (met.where("differ").groupBy(*HULL)
               .agg(F.min(F.struct("k2", "context", "first", "last")).alias("s")).select(*HULL, "s.*"))
    each = land(_strings(samples.join(pieces, ["k2", "context"]).select(*HULL, "first", "last", "piece"), length),
                "strings")
    twice = each.groupBy("w1", "w2").agg(F.count("*").alias("places")).where("places > 1").select("w1", "w2")
    hit = each.join(twice, ["w1", "w2"]).select(*HULL, "i")
    single = met.where("differ").join(hit, HULL).select(
        "k2", "context", (F.col("first") + F.col("i")).alias("first"), (F.col("first") + F.col("i")).alias("last"))
    return whole.unionByName(single)


def repeated_spans(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """(k, c, start, end) byte spans of keyed ``docs`` that strings of ``length`` bytes which also start elsewhere
    cover; spans may overlap."""
    suffixes = land(_suffixes(docs, length, batches), "suffixes", partition_by="batch")
    index, matches = SuffixIndex(), None
    for batch in range(batches):
        found = index.add(suffixes.where(F.col("batch") == batch))
        matches = found if matches is None else matches.unionByName(found)
    # landed first: Spark can split the join at a frequent anchor only if no aggregation stands between
    everywhere = land(matches.distinct(), "all-matches")
    met = land(suffixes.drop("batch").join(everywhere, KEY), "suffix-meetings")
    classes = land(met.groupBy(*KEY, "context").agg(
        F.count("*").alias("places"), F.min(F.struct("k", "c", "at", "n", "left")).alias("sample")), "contexts")
    whole = classes.where("places > 1").select(
        "k2", "context", F.lit(0).alias("first"), (F.col("sample.n") - 1).cast("int").alias("last"))
    partial = _partial_matches(classes, docs, length).join(
        classes.where("places > 1").select("k2", "context"), ["k2", "context"], "left_anti")
    runs = land(whole.unionByName(partial), "repeated-strings")
    return met.join(runs, ["k2", "context"]).select(
        "k", "c", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + length).alias("end"))


def _joined(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for span in spans:
        if out and span["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span["end"]))
        else:
            out.append((span["start"], span["end"]))
    return out


def _merged(column: str):
    @F.pandas_udf("array<struct<start int, end int>>")
    def merge(lists: pd.Series) -> pd.Series:
        return pd.Series([_joined(spans) for spans in lists], dtype=object)

    return merge(F.col(column))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 batches: int = BATCHES) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row: ``spans`` are the maximal removed byte runs (start, end),
    ``kept`` the remaining bytes.

    A byte is removed if a string of ``length`` bytes that also starts anywhere else, in the same document or another
    one, covers it; strings are judged on the input.
    """
    if length < GRAM or batches < 1:
        raise ValueError(f"length must be at least {GRAM} and batches positive")
    ship_package(docs.sparkSession)
    marked = with_document_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")),
                               "id", "__text")
    # spans are first merged per stretch of a document, so that a long one full of matches is not gathered at once
    sorted_spans = F.sort_array(F.collect_list(F.struct("start", "end")))
    stretch = F.floor(F.col("start") / STRETCH).alias("stretch")
    merged = (repeated_spans(marked, length, batches).groupBy("k", "c", stretch).agg(sorted_spans.alias("found"))
              .select("k", "c", F.explode(_merged("found")).alias("s")).select("k", "c", "s.start", "s.end"))
    spans = land(merged.groupBy("k", "c").agg(sorted_spans.alias("found")), "repeated-spans")

    @F.pandas_udf("struct<spans array<struct<start int, end int>>, kept binary>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, parts in zip(texts, found):
            raw, spans, kept, at = text.encode("utf-8"), _joined(parts if parts is not None else ()), [], 0
            for start, end in spans:
                kept.append(raw[at:start])
                at = end
            kept.append(raw[at:])
            out.append((spans, b"".join(kept)))
        return pd.DataFrame(out, columns=["spans", "kept"])

    text = F.coalesce("__text", F.lit(""))
    joined = marked.join(spans, (F.col("__k") == F.col("k")) & (F.col("__c") == F.col("c")), "left")
    done = joined.withColumn("done", cut(text, F.col("found")))
    return done.select("id", F.octet_length(text).cast("long").alias("n_bytes"),
                       (F.octet_length(text) - F.octet_length("done.kept")).cast("long").alias("n_removed"),
                       F.col("done.spans").alias("spans"), F.col("done.kept").alias("kept"))
