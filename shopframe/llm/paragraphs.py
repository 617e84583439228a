"""Near-duplicate paragraph removal: MinHash banding of lines, exact classes of the blocks inside them.

Units. A paragraph is a line. As a repeated passage may also stand inside longer lines, a line is further cut into
blocks at words chosen by content: the word with the smallest hash of each 25 words in a row starts a block, so two
copies of a passage of over 50 words are cut alike whatever surrounds them. Units of fewer than ``min_words`` words
are left alone.

Links. Units with equal words (white space and ASCII case aside) are one class. The classes of lines also get
MinHash bands over five-word shingles; the number of bands is the smallest that finds a pair at the threshold with
the wanted recall. Lines that meet in a band are verified by the exact Jaccard similarity of their shingle sets, and
linked classes are joined into components.

What stays. Lines are decided first: of each component the line with the smallest (document id, position) stays, all
others are removed. Blocks inside removed lines go with them and are no place to stay. Of the other blocks of a class
the first stays, or none where a line of the component stays. A block is not removed for that line where it stands in
it, or where its own line is no longer than it (such a line is tied to the block by a chain of links only, and two
lines could otherwise each lose the part that the other one is kept for).

A band of very many lines does not emit all its pairs: every line is first compared with the smallest of its band;
after the components of those links are known, only pairs of different components are compared, and of them none
inside a band's largest component. Where such a band is crowded (lines that share a passage, but little else, meet by
the thousand), the lines' shingles are ordered from the rarest of the band to the commonest. Two lines at the threshold
share a shingle near the start of both orders, so only lines that share one there, at places that leave enough of both,
are compared; no pair at the threshold is lost.

Defined results: a null text counts as empty and stays null; rows that repeat id and text are one document, but
each row with a null id is one of its own; null ids come after all others (by a hash of the text) and are not named in
kept_in; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, land, separate_rows, ship_package
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MIN_WORDS = 8
WINDOW = 25
BAND_ROWS = 2
CROWDED = 32


def bands_for(threshold: float = THRESHOLD, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """Smallest number of bands of ``rows`` hashes that finds a pair at ``threshold`` with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def paragraph_units(texts: list[bytes], min_words: int = MIN_WORDS, window: int = WINDOW, bands: int = 7,
                    rows: int = BAND_ROWS) -> pd.DataFrame:
    """Units of the texts: doc (index), start and end (byte span with the white space that follows), line and line_end
    (the same of the line a unit lies in), c1, c2 (128-bit hash of the words), bands (of lines; null for blocks)."""
    whole = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(whole, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank, [1])).astype(np.int8)))
    starts = edge[0::2]
    n = len(starts)
    columns = ["doc", "start", "end", "line", "line_end", "c1", "c2", "bands"]
    if not n:
        return pd.DataFrame({c: np.zeros(0, object if c == "bands" else np.int64) for c in columns})
    words = whole.lower().split()
    doc_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_at, starts, "right") - 1
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    new_line = np.concatenate(([True], line[1:] != line[:-1]))
    hashes = _mixed(np.fromiter((crc32(w) for w in words), np.uint64, n))

    cut = new_line.copy()
    if n >= window:
        # hash and position in one number: the smallest hash, of equal ones the first
        low = _sliding_min((hashes >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64), window)
        chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[doc[:n - window + 1] == doc[window - 1:]]
        cut[chosen] = True
    next_start = np.concatenate((starts[1:], [len(whole)]))
    next_start = np.minimum(next_start, doc_at[doc + 1])

    def spans(flags):
        first = np.flatnonzero(flags)
        return first, np.concatenate((first[1:], [n]))

    line_first, line_end = heads, tails = spans(new_line)
    block_first, block_end = spans(cut)
    whole_line = new_line[block_first] & np.concatenate((new_line[block_first[1:]], [True]))
    block_first, block_end = block_first[~whole_line], block_end[~whole_line]
    keep = line_end - line_first >= min_words
    line_first, line_end = line_first[keep], line_end[keep]
    keep = block_end - block_first >= min_words
    block_first, block_end = block_first[keep], block_end[keep]

    first, end = np.concatenate((line_first, block_first)), np.concatenate((line_end, block_end))
    joined = b" ".join(words)
    sizes = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    at, to = np.concatenate(([0], sizes[:-1]))[first], sizes[end - 1] - 1
    digests = b"".join(xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(at.tolist(), to.tolist()))
    classes = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
    lists: list = [None] * len(first)
    if len(line_first):
        keys = _band_keys(hashes, line_first, line_end, bands, rows)
        lists[:len(line_first)] = list(keys)
    base, inside = doc_at[doc[first]], np.searchsorted(heads, first, "right") - 1
    return pd.DataFrame({"doc": doc[first], "start": starts[first] - base, "end": next_start[end - 1] - base,
                         "line": starts[heads[inside]] - base, "line_end": next_start[tails[inside] - 1] - base,
                         "c1": classes[:, 0], "c2": classes[:, 1], "bands": pd.Series(lists, dtype=object)})


def _band_keys(hashes, first, end, bands, rows) -> np.ndarray:
    """One row of band keys for each line: MinHashes of its five-word shingles, ``rows`` of them to a key."""
    shingles = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        shingles = _mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + len(shingles)])
    ranges = np.column_stack((first, end - SHINGLE + 1)).ravel()
    shingles = np.append(shingles, np.uint64(0))  # reduceat wants every end inside
    out = np.empty((len(first), bands), np.int64)
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for b in range(bands):
        key = np.full(len(first), b, np.uint64)
        for r in range(rows):
            mixed = (shingles ^ seeds[b * rows + r]) * np.uint64(0xFF51AFD7ED558CCD)
            key = _mixed(key * np.uint64(31) + np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), ranges)[::2])
        out[:, b] = key.view(np.int64)
    return out


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of a text (fewer words: the whole sequence)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = (b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64).view(np.int64))


def _similar(a: str, b: str, threshold: float):
    """Exact Jaccard similarity of two shingle columns, as a join condition: a band's pairs are compared where they
    meet, and only links leave the join."""
    both = F.size(F.array_intersect(a, b))
    return both >= (F.size(a) + F.size(b) - both) * F.lit(threshold)


def _units(docs: DataFrame, min_words: int, window: int, bands: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at:at + 64]
                found = paragraph_units([t.encode("utf-8") for t in part["text"]], min_words, window, bands)
                doc = found.pop("doc").to_numpy(np.int64)
                found.insert(0, "k", part["k"].to_numpy(np.int64)[doc])
                found.insert(1, "c", part["c"].to_numpy(np.int64)[doc])
                yield found.astype({x: "int64" for x in ("start", "end", "line", "line_end", "c1", "c2")})

    source = docs.select(F.col("__k").alias("k"), F.col("__c").alias("c"), F.coalesce("__text", F.lit("")).alias("text"))
    return source.mapInPandas(cut, "k long, c long, start long, end long, line long, line_end long, c1 long, c2 long, "
                                "bands array<long>")


def _line_links(units: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links between classes of lines that join what pairs at ``threshold`` or more join."""
    lines = land(units.where("bands is not null").groupBy(F.struct("c1", "c2").alias("node"))
                 .agg(F.count("*").alias("n"), F.min(F.struct("k", "c", "start", "end")).alias("at"),
                      F.min("bands").alias("bands")), "lines")
    keyed = lines.select("node", "n", F.explode("bands").alias("key"))
    # the line that is repeated most is the likeliest to be what the others of a band were copied from
    hubs = (keyed.groupBy("key").agg(F.max(F.struct("n", "node")).alias("hub"), F.min("node").alias("low"),
                                     F.max("node").alias("high"))
            .where("low <> high").select("key", F.col("hub.node").alias("hub")))
    met = land(keyed.select("key", "node").join(hubs, "key"), "line-meetings")

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t) for t in texts], dtype=object)

    wanted = lines.select("node", "at.*").join(met.select("node").distinct(), "node")
    sets = land(_cut_out(wanted, docs).select("node", shingles("text").alias("s")), "line-shingles")

    def named(name):
        return sets.select(F.col("node").alias(name), F.col("s").alias(f"s_{name}"))

    stars = met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = land(stars, "stars")  # so that Spark can split the join at a hub of very many lines
    stars = stars.join(named("a"), "a").join(named("b"), "b")
    first = land(stars.where(_similar("s_a", "s_b", threshold)).select("a", "b"), "hub-links")
    joined = connected_components(first)
    labelled = land(met.select("key", "node").join(joined, "node", "left")
                    .select("key", "node", F.coalesce("component", "node").alias("label")), "line-labels")
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = (sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"),
                                        F.sum("n").alias("met"))
               .where("labels > 1").select("key", F.col("top.label").alias("top"), "met"))
    open_keys = labelled.join(largest, "key").join(sets, "node")
    open_keys = land(open_keys.withColumn("row", F.monotonically_increasing_id()), "open-bands")

    def side(rows, name):
        return rows.select("key", F.col("node").alias(name), F.col("label").alias(f"label_{name}"),
                           (F.col("label") == F.col("top")).alias(f"top_{name}"), F.col("s").alias(f"s_{name}"))

    few = open_keys.where(F.col("met") <= CROWDED)
    pairs = side(few.where("label <> top"), "a").join(side(few, "b"), "key")
    crossing = pairs.where((F.col("label_a") != F.col("label_b")) & (F.col("top_b") | (F.col("a") < F.col("b")))
                           & _similar("s_a", "s_b", threshold)).select("a", "b")
    near = land(_crowded_pairs(open_keys.where(F.col("met") > CROWDED), threshold), "crowded-pairs")
    near = near.join(named("a"), "a").join(named("b"), "b").where(_similar("s_a", "s_b", threshold)).select("a", "b")
    crossing = crossing.unionByName(near)
    return first.unionByName(crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _crowded_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) nodes of ``rows(row, key, node, label, top, s)`` that meet under a key: all pairs at the threshold whose
    labels differ, and few others. A set of n shingles, ordered by how many sets of its key hold them, shares with one
    at the threshold a shingle among its first n - share * n + 1, where the share is ``threshold``, or for the smaller
    set of the two 2 * threshold / (1 + threshold); what follows that shingle in both holds the rest they share."""
    def needed(n, share):
        return F.ceil(n * F.lit(share) - F.lit(1e-6))  # rounding must not ask for more than there is

    both = threshold / (1 + threshold)
    held = rows.select("key", "row", F.explode("s").alias("t"))
    held = held.withColumn("n", F.count("*").over(Window.partitionBy("key", "t"))).where("n > 1")
    common = held.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("common"))
    ordered = rows.select("row", "key", "node", "label", (F.col("label") == F.col("top")).alias("inner"),
                          F.size("s").alias("n")).join(common, "row")
    # the shingles that no other set of the key holds come first
    alone = F.col("n") - F.size("common")
    long = F.greatest(F.col("n") - needed(F.col("n"), threshold) + 1 - alone, F.lit(0)).cast("int")
    marks = ordered.select("key", "node", "label", "inner", "n", alone.alias("alone"),
                           F.posexplode(F.slice("common", F.lit(1), long)).alias("i", "c"))
    marks = land(marks.select("key", F.col("c.t").alias("t"), "node", "label", "inner", "n",
                              (F.col("alone") + F.col("i")).alias("at")), "band-marks")

    def side(found, name):
        return found.select("key", "t", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "label", "n", "at")])

    def met(small, large):
        rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        return side(small, "a").join(side(large, "b"), ["key", "t"]).where(
            (F.col("label_a") != F.col("label_b")) & (F.struct("n_a", "node_a") < F.struct("n_b", "node_b"))
            & (F.col("n_a") >= needed(F.col("n_b"), threshold)) & (rest >= needed(F.col("n_a") + F.col("n_b"), both)))

    short = marks.where(F.col("at") <= F.col("n") - needed(F.col("n"), 2 * both))
    found = met(short.where("not inner"), marks).unionByName(met(short.where("inner"), marks.where("not inner")))
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _cut_out(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the spans ``wanted(node, k, c, start, end)``."""
    spans = wanted.groupBy("k", "c").agg(F.collect_list(F.struct("node", "start", "end")).alias("spans"))
    source = docs.select(F.col("__k").alias("k"), F.col("__c").alias("c"), F.encode("__text", "UTF-8").alias("raw"))
    cut = source.join(spans, ["k", "c"]).select(F.explode("spans").alias("s"), "raw")
    piece = F.substring("raw", F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int"))
    return cut.select("s.node", F.decode(piece, "UTF-8").alias("text")).dropDuplicates(["node"])


def _removed(placed: DataFrame) -> DataFrame:
    """(k, c, start, end, kept_k) of the units to remove of ``placed(k, c, start, end, line, line_end, label, whole)``."""
    def places(kind):
        return F.min(F.struct(F.lit(kind).alias("inner"), "k", "c", "start", (F.col("end") - F.col("start")).alias("size")))

    lines = placed.where("whole")
    first_lines = land(lines.groupBy("label").agg(places(False).alias("first")), "first-lines")
    gone_lines = land(lines.join(first_lines, "label").where(
        F.struct("k", "c", "start") != F.struct("first.k", "first.c", "first.start"))
        .select("k", "c", "start", "end", F.col("first.k").alias("kept_k")), "removed-lines")
    # a place to stay must stand in the result, so blocks of removed lines are out before the first one is chosen
    blocks = land(placed.where("not whole").join(gone_lines.select("k", "c", F.col("start").alias("line")),
                                                 ["k", "c", "line"], "left_anti"), "standing-blocks")
    first = land(blocks.groupBy("label").agg(places(True).alias("first")).unionByName(first_lines)
                 .groupBy("label").agg(F.min("first").alias("first")), "first-places")
    own_line = F.struct("k", "c", "line") == F.struct("first.k", "first.c", "first.start")
    gone = blocks.join(first, "label").where(F.when(
        F.col("first.inner"), F.struct("k", "c", "start") != F.struct("first.k", "first.c", "first.start"))
        .otherwise(~own_line & (F.col("line_end") - F.col("line") > F.col("first.size"))))
    return land(gone_lines.unionByName(gone.select("k", "c", "start", "end", F.col("first.k").alias("kept_k"))),
                "removed-units")


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with text_col freed of repeated paragraphs, and the columns n_removed (removed
    units), bytes_removed and kept_in (ids of the documents that keep the removed units, sorted).

    Extra columns pass through; columns named n_removed, bytes_removed or kept_in are replaced.
    """
    ship_package(docs.sparkSession)
    marked = separate_rows(docs, id_col, text_col)
    units = land(_units(marked, min_words, window, bands_for(threshold, recall=recall)), "paragraph-units")
    links = _line_links(units, marked, threshold)
    linked = connected_components(links).select("node.c1", "node.c2", F.col("component").alias("label"))
    repeated = (units.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"))
    classes = land(repeated.join(linked, ["c1", "c2"], "full")
                   .select("c1", "c2", F.coalesce("label", F.struct("c1", "c2")).alias("label")), "classes")
    placed = land(units.join(classes, ["c1", "c2"]).select(
        "k", "c", "start", "end", "line", "line_end", "label", F.col("bands").isNotNull().alias("whole")), "placed-units")
    spans = _removed(placed)
    spans = spans.distinct().groupBy(F.col("k").alias("__k"), F.col("c").alias("__c")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"),
        F.sort_array(F.collect_set(F.when(F.col("kept_k") < NO_ID, F.col("kept_k")))).alias("kept_in"))

    @F.pandas_udf("struct<text string, bytes_removed long>")
    def freed(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, cuts in zip(texts, spans):
            if text is None or cuts is None:
                out.append((text, 0))
                continue
            raw, at, kept = text.encode("utf-8"), 0, []
            for cut in cuts:
                if cut["start"] > at:
                    kept.append(raw[at:cut["start"]])
                at = max(at, cut["end"])
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((left.decode("utf-8"), len(raw) - len(left)))
        return pd.DataFrame(out, columns=["text", "bytes_removed"])

    rest = [c for c in docs.columns if c not in ("n_removed", "bytes_removed", "kept_in")]
    done = marked.join(spans, ["__k", "__c"], "left").withColumn("__done", freed("__text", "__spans"))
    return done.select(*[F.col("__done.text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in rest],
                       F.coalesce(F.size("__spans"), F.lit(0)).cast("long").alias("n_removed"),
                       F.col("__done.bytes_removed").alias("bytes_removed"),
                       F.coalesce("kept_in", F.array().cast("array<long>")).alias("kept_in"))
