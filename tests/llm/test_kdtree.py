"""Top-k search against brute force with ties, repeated rows and rows that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopframe.llm import kdtree as K


def plain(rows, k, step):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % step == 0:
            scores = [(max(min(sum(a * b for a, b in zip(x, y)), 2 ** 63 - 1), -2 ** 63), i)
                      for i, y in ok if i != q and len(y) == len(x)]
            best = sorted((-s, i) for s, i in scores)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<double>, id string, part string")


def vectors(n, dim, seed=0, grid=None):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) if grid is None else rng.randrange(grid) / 1024 for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("data", [
    vectors(900, 16), vectors(700, 3, 1, grid=3),  # many ties
    vectors(60, 4, 2) + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan"), 0.0, 0.0, 0.0]),
                         (70, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (80, [1.0, 2.0]), (81, [2.0, 1.0]),
                         (90, []), (91, []), (5, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0, 1.0])],
    [(i, [x * 1e12 for x in v]) for i, v in vectors(40, 4, 3)],  # sums beyond 53 and 64 bits
])
def test_equal_to_brute_force(spark, data):
    out = K.top_k(frame(spark, data), F.col("vec_id") % 10 == 0, k=10, shard_rows=128, block_rows=16)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == plain(data, 10, 10)


def test_repeated_rows_and_few_candidates(spark):
    data = [(1, [1.0]), (1, [1.0]), (2, [2.0])]
    out = K.top_k(frame(spark, data), F.col("vec_id") == 2, k=10).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (2, 1)]


def test_empty_table_and_no_queries(spark):
    data = frame(spark, vectors(30, 4))
    assert K.top_k(data.limit(0), F.lit(True)).collect() == []
    assert K.top_k(data, F.lit(False)).collect() == []


def test_boxes_are_tight():
    x = np.random.default_rng(0).integers(-50, 50, (1000, 5)).astype(float)
    ids, y, boxes = K.build_tree(np.arange(1000), x)
    assert sorted(map(tuple, y)) == sorted(map(tuple, x)) and (x[ids] == y).all()
    for (a, b, _), (low, high) in zip(K.nodes_of(1000), boxes):
        assert (low == y[a:b].min(0)).all() and (high == y[a:b].max(0)).all()


def test_a_shard_keeps_k_of_many_equal_vectors():
    ids, x = np.arange(16_000)[::-1].copy(), np.ones((16_000, 4))
    tree = K.build_tree(ids, x)
    (_, best), = K.search_tree(tree, [3], np.ones((1, 4)), [-math.inf], 10)
    assert best == [(4, i) for i in (0, 1, 2, 4, 5, 6, 7, 8, 9, 10)]
