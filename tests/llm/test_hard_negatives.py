"""Hard negatives against brute force over every window."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopframe.llm import hard_negatives as H
from shopframe.llm.common import land

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, step, positives, k, low, high, scale):
    ok = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, label, x in ok:
        if q % step:
            continue
        found = sorted((-max(min(sum(a * b for a, b in zip(x, y)), 2 ** 63 - 1), -2 ** 63), i, other)
                       for i, other, y in ok if i != q and len(y) == len(x))
        for s, i, _ in [f for f in found if f[2] == label][:positives]:
            fit = [(-n, j) for n, j, other in found if other != label and low * -s <= 100 * -n <= high * -s]
            out += [(q, i, r, j, -s, n) for r, (n, j) in enumerate(fit[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "x") for i, y, v in rows],
                                 "vec_id long, label int, embedding array<double>, at int, `score.id` string")


def vectors(n, dim, seed, labels=3, grid=None, shift=0.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.gauss(shift, 1) if grid is None else rng.randrange(grid) / 256
                                        for _ in range(dim)]) for i in range(n)]


CASES = {
    "plain": vectors(700, 8, 0, shift=0.4),
    "ties": vectors(600, 3, 1, grid=3),
    "one label": [(i, 1, v) for i, _, v in vectors(60, 4, 2)],
    "hot label": [(i, 0 if i % 3 else i % 7, v) for i, _, v in vectors(500, 4, 3, shift=0.5)],
    "copies": [(i, i % 2, [0.5, 0.25]) for i in range(300)] + vectors(50, 2, 4),
    "odd": vectors(80, 4, 5, shift=0.5) + [
        (None, 1, [9.0, 9.0, 9.0, 9.0]), (81, None, [1.0] * 4), (82, 1, None), (83, 1, [1.0, None, 0.0, 0.0]),
        (84, 1, [float("nan"), 0.0, 0.0, 0.0]), (85, 1, [float("inf"), 0.0, 0.0, 0.0]), (90, 1, [1.0, 2.0]),
        (91, 1, [2.0, 1.0]), (92, 2, [1.0, 1.0]), (100, 1, []), (101, 1, []), (102, 2, []), (0, 1, [0.5] * 4),
        (0, 1, [0.5] * 4), (7, 2, [0.4] * 4), (7, 2, [0.4] * 4)],
    "large": [(i, y, [x * 1e15 for x in v]) for i, y, v in vectors(60, 4, 6, shift=0.7)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_equal_to_brute_force(spark, case):
    rows = CASES[case]
    out = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, rows_per_block=128, anchors_per_block=8)
    assert sorted(tuple(r[c] for c in FIELDS) for r in out.collect()) == plain(rows, 10, 5, 10, 30, 90, 256)


def test_other_windows_and_no_anchors(spark):
    rows = vectors(200, 4, 8, shift=0.5)
    out = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, positives=3, k=2, low=0, high=120)
    assert sorted(tuple(r[c] for c in FIELDS) for r in out.collect()) == plain(rows, 20, 3, 2, 0, 120, 256)
    assert H.hard_negatives(frame(spark, rows), F.lit(False)).collect() == []


def test_blocks_do_not_pass_through_the_driver(spark):
    """Blocks that are small on disk are large once they stand beside every part."""
    everyone = H.labelled_vectors(frame(spark, vectors(400, 8, 9)), F.col("label"), "vec_id", "embedding")
    blocks = land(H._blocks(everyone, 2, 256), "test-blocks")
    anchors = blocks.select(F.col("part").alias("block"), "dim", *[F.col(c).alias(f"a_{c}") for c in
                                                                   ("ids", "labels", "vectors")])
    pairs = H._pairs(anchors, 2, blocks)
    assert pairs.count() == 4 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    out = H.hard_negatives(frame(spark, vectors(400, 8, 9)), F.col("vec_id") % 10 == 0, rows_per_block=128)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-60, 60), max_size=5), st.lists(st.integers(-70, 70), max_size=60), st.integers(1, 6))
def test_suffix_merges_answer_every_window(positives, scores, k):
    limits, least = H.slot_limits(positives, 30, 90)
    by_slot = {}
    for row, s in enumerate(scores):
        if limits and least <= s <= limits[-1]:
            by_slot.setdefault(int(np.searchsorted(limits, s)), []).append((-s, row))
    kept = [(slot, -s, row) for slot, found in by_slot.items() for s, row in sorted(found)[:k]]
    expected = [[(s, row) for s, row in sorted(((s, row) for row, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))
                 if 30 * p <= 100 * s <= 90 * p][:k] for p in positives]
    assert H.merged_slots(kept, positives, 30, 90, k) == expected


def test_best_of_takes_the_smaller_id_of_equal_scores():
    scores, ids = np.array([5, 7, 7, 5, 7, -2 ** 63]), np.array([4, 9, 2, 1, 3, 0])
    assert H.best_of(scores, ids, 2).tolist() == [2, 4]
    assert H.best_of(scores, ids, 5).tolist() == [2, 4, 1, 3, 0]
    assert H.best_of(scores, ids, 9).tolist() == [2, 4, 1, 3, 0, 5]
