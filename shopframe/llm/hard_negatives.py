"""Hard negatives by slot-decomposed selection.

Every anchor has up to ``positives`` positives, and each of them asks for the best negatives inside a window of scores
that its own score sets. The windows of one anchor overlap, so they are not searched one by one: their upper limits cut
the scores into disjoint slots (a score belongs to the smallest upper limit that it does not exceed). Blocks of anchors
meet blocks of rows; a block keeps the ``k`` best negatives of every anchor and slot, and a grouped limit combines these
before and after the shuffle. The slots of an anchor are then merged from the lowest score range upwards, keeping ``k``:
what has been merged when a window's upper limit is reached is the best of everything below it, and the window is the
part that reaches its lower limit. A row is thus looked at once for the positives and once for all windows, and what is
kept for an anchor (positives x k rows) does not depend on the size of the table, of a label or of a group of copies.
Blocks are few rows of some MB each, small on disk and repeated for every part, which Spark's estimates do not see; so
they meet in merge joins, and none of them passes through the driver.

Scores are integer inner products of floor(scale * x), as doubles while all sums stay below 2^53 and as integers of any
size otherwise; a score beyond 64 bits counts as the nearest long.

Defined results: rows with a null id or label, a null vector, or a null, infinite or NaN component take no part; only
vectors of as many components are compared; rows of an anchor's own id are neither its positives nor its negatives; rows
that repeat count each, as anchors too; equal scores are ordered by the smaller id; a window whose lower limit is above
its upper one (a negative positive score) is empty; fewer rows than asked for are all returned; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, ship_package
from .kdtree import scaled

BLOCK = "part int, dim int, ids binary, labels binary, vectors binary"
ROWS_PER_BLOCK = 8_192
ANCHORS_PER_BLOCK = 1_024
ANCHORS_AT_ONCE = 64
KEY = ["block", "dim", "at"]


def labelled_vectors(rows: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col(id_col).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"))


def _blocks(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """The rows dealt evenly to ``parts`` parts, one packed row for each part and number of components."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        frame = pd.concat(got)
        for dim, group in frame.groupby(frame["v"].map(len)):
            packed = (group["id"].to_numpy("<i8").tobytes(), group["label"].to_numpy("<i8").tobytes(),
                      scaled(group["v"], int(dim), scale).tobytes())
            yield pd.DataFrame([(TaskContext.get().partitionId(), int(dim), *packed)],
                               columns=["part", "dim", "ids", "labels", "vectors"])

    return rows.repartition(parts).mapInPandas(pack, BLOCK)


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, one line an anchor; beyond 64 bits the nearest long."""
    top = [float(np.abs(a).max(initial=0)) for a in (anchors, rows)]
    if top[0] * top[1] * max(1, rows.shape[1]) < 2 ** 53:
        return (anchors @ rows.T).astype(np.int64)
    a, b = (np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape) for m in (anchors, rows))
    return np.minimum(np.maximum(a @ b.T, -2 ** 63), 2 ** 63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in that order."""
    places = np.arange(len(scores))
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= kth)
    return places[np.lexsort((ids[places], -scores[places].astype(object) if len(places) and
                              scores[places].min() == -2 ** 63 else -scores[places]))][:k]


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and largest negative score with low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def slot_limits(positive_scores: list[int], low: int, high: int) -> tuple[list[int], int]:
    """The distinct upper limits of the windows that are not empty, ascending, and the smallest lower limit."""
    windows = [(a, b) for a, b in (window_of(s, low, high) for s in positive_scores) if a <= b]
    return sorted({b for _, b in windows}), min((a for a, _ in windows), default=0)


def merged_slots(kept: list[tuple[int, int, int]], positive_scores: list[int], low: int, high: int,
                 k: int) -> list[list[tuple[int, int]]]:
    """For every positive score the first k (score, id) inside its window. ``kept`` holds (slot, score, id), the k best
    of each slot at least; slots are numbered by their upper limits, ascending."""
    limits, _ = slot_limits(positive_scores, low, high)
    slots: list[list] = [[] for _ in limits]
    for slot, score, row in kept:
        slots[slot].append((-score, row))
    below, merged = [], {}
    for limit, slot in zip(limits, slots):
        below = sorted(slot + below)[:k]
        merged[limit] = below
    out = []
    for score in positive_scores:
        a, b = window_of(score, low, high)
        out.append([(-s, row) for s, row in merged.get(b, []) if -s >= a] if a <= b else [])
    return out


def _pairs(blocks: DataFrame, parts: int, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows with as many components."""
    every = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return every.join(rows.hint("merge"), ["part", "dim"])


def _unpacked(r):
    ids, labels = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8")
    a_ids, a_labels = np.frombuffer(r.a_ids, "<i8"), np.frombuffer(r.a_labels, "<i8")
    return (ids, labels, np.frombuffer(r.vectors).reshape(len(ids), r.dim), a_ids, a_labels,
            np.frombuffer(r.a_vectors).reshape(len(a_ids), r.dim))


def _each_anchor(r):
    """(place in the block, anchor id, scores, whether of another id, whether of the same label, row ids)."""
    ids, labels, rows, a_ids, a_labels, anchors = _unpacked(r)
    for at in range(0, len(a_ids), ANCHORS_AT_ONCE):
        scores = scores_of(anchors[at:at + ANCHORS_AT_ONCE], rows)
        for i, line in enumerate(scores, at):
            yield i, int(a_ids[i]), line, ids != a_ids[i], labels == a_labels[i], ids


def _positives(pairs: DataFrame, count: int) -> DataFrame:
    """(block, dim, at, anchor_id, rank, score, id): the best rows of the anchor's label."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                out = []
                for i, anchor, scores, other, same, ids in _each_anchor(r):
                    take = np.flatnonzero(other & same)
                    for p in take[best_of(scores[take], ids[take], count)]:
                        out.append((r.block, r.dim, i, anchor, int(scores[p]), int(ids[p])))
                yield pd.DataFrame(out, columns=[*KEY, "anchor_id", "score", "id"])

    found = pairs.mapInPandas(search, "block int, dim int, at int, anchor_id long, score long, id long")
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _slot_rows(pairs: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """(block, dim, at, slot, score, id): the k best rows of other labels in every slot of an anchor."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                wanted: dict[int, list[int]] = {}
                for p in r.positives:
                    wanted.setdefault(p["at"], []).append(p["score"])
                out = []
                for i, _, scores, other, same, ids in _each_anchor(r):
                    limits, least = slot_limits(wanted.get(i, []), low, high)
                    if not limits:
                        continue
                    take = np.flatnonzero(other & ~same & (scores <= limits[-1]) & (scores >= least))
                    slot = np.searchsorted(np.array(limits, np.int64), scores[take], side="left")
                    for n in np.unique(slot):
                        of = take[slot == n]
                        out += [(r.block, r.dim, i, int(n), int(scores[p]), int(ids[p]))
                                for p in of[best_of(scores[of], ids[of], k)]]
                yield pd.DataFrame(out, columns=[*KEY, "slot", "score", "id"])

    found = pairs.mapInPandas(search, "block int, dim int, at int, slot int, score long, id long")
    order = Window.partitionBy(*KEY, "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _windows(anchors: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """The negatives of every positive, from the kept rows of the anchor's slots."""
    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                scores = [p["score"] for p in r.positives]
                found = merged_slots([(s["slot"], s["score"], s["id"]) for s in r.kept], scores, low, high, k)
                out += [(r.anchor_id, p["id"], n, row, p["score"], score) for p, rows in zip(r.positives, found)
                        for n, (score, row) in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])

    return anchors.select("anchor_id", "positives", "kept").mapInPandas(merge, RESULT)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, k: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id",
                   vector_col: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK,
                   anchors_per_block: int = ANCHORS_PER_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row that ``is_anchor``
    selects and each of its ``positives`` best rows of the same label, the ``k`` best rows of other labels whose score
    lies between ``low`` and ``high`` per cent of the positive's."""
    if min(positives, k, rows_per_block, anchors_per_block) < 1 or not 0 <= low <= high:
        raise ValueError("positives, k and block sizes must be positive, and 0 <= low <= high")
    ship_package(rows.sparkSession)
    label = F.col("label") if label is None else label
    everyone = labelled_vectors(rows, label, id_col, vector_col)
    anchors = labelled_vectors(rows.where(is_anchor), label, id_col, vector_col)
    parts = max(1, math.ceil(everyone.count() / rows_per_block))
    n_blocks = max(1, math.ceil(anchors.count() / anchors_per_block))
    dealt = land(_blocks(everyone, parts, scale), "labelled-blocks")
    blocks = land(_blocks(anchors, n_blocks, scale).select(
        F.col("part").alias("block"), "dim", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"),
        F.col("vectors").alias("a_vectors")), "anchor-blocks")
    best = land(_positives(_pairs(blocks, parts, dealt), positives), "positives")
    # at most anchors_per_block x positives short structs
    wanted = best.groupBy("block", "dim").agg(F.collect_list(F.struct("at", "score")).alias("positives"))
    asked = land(blocks.join(wanted.hint("merge"), ["block", "dim"]), "anchor-blocks")
    kept = _slot_rows(_pairs(asked, parts, dealt), low, high, k)
    slots = kept.groupBy(*KEY).agg(F.collect_list(F.struct("slot", "score", "id")).alias("kept"))
    of_anchor = best.groupBy(*KEY, "anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    return _windows(of_anchor.join(slots.hint("merge"), KEY), low, high, k)
