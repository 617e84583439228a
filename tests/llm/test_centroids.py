"""Centroid clustering against plain Python rounds."""

import hashlib
import math
import random

import pytest

from shopframe.llm import centroids as C


def plain(rows, k, rounds, dim, scale):
    kept = [(i, [max(-C.LIMIT, min(C.LIMIT, math.floor(scale * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]

    def order(row):
        return row[0] is None, "" if row[0] is None else hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1]
    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        best = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, best) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    best = assign()
    inertia = {n: sum(d for d, c in best if c == n) for n in range(len(centroids))}
    top = C.LONG_MAX
    return sorted(((i if i is not None else -1, c, d, min(inertia[c], top), min(sum(inertia.values()), top),
                    tuple(centroids[c])) for (i, _), (d, c) in zip(kept, best)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows],
                                 "vec_id long, embedding array<double>, cluster int, id string, `v.a` string")


def vectors(n, dim, seed=0, grid=None):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) if grid is None else rng.randrange(-grid, grid) / 1024 for _ in range(dim)])
            for i in range(n)]


CASES = {
    "plain": (vectors(300, 8), 8, 8),
    "ties": (vectors(200, 2, 1, grid=2), 8, 2),
    "copies": ([(i, [0.5, -0.25]) for i in range(60)] + vectors(10, 2, 2), 4, 2),
    "few": (vectors(3, 4, 3), 8, 4),
    "odd": (vectors(40, 3, 4) + [(50, None), (51, [1.0, None, 0.0]), (52, [float("nan"), 0.0, 0.0]), (53, [0.0, 1.0]),
                                 (54, [float("-inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (55, []), (7, [0.1, 0.2, 0.3]),
                                 (56, [1e30, -1e30, 0.0]), (57, [-0.0, 0.0, 1e-9])], 5, 3),
    "empty": ([], 8, 4),
}


@pytest.mark.parametrize("case", CASES)
def test_equal_to_plain_rounds(spark, case):
    rows, k, dim = CASES[case]
    out = C.centroid_clusters(frame(spark, rows).repartition(3), clusters=k, rounds=4, dim=dim).collect()
    got = sorted(((-1 if r.id is None else r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid))
                  for r in out), key=str)
    assert got == plain(rows, k, 4, dim, 1024)


def test_sums_beyond_a_long(spark):
    rows = [(i, [200_000.0 * (-1) ** (i % 2)] * 64) for i in range(40)]
    got = C.centroid_clusters(frame(spark, rows), clusters=1, rounds=2).collect()
    assert {(r.inertia, r.distance > 0) for r in got} == {(r[4], r[2] > 0) for r in plain(rows, 1, 2, 64, 1024)}


def test_no_python_in_the_plan(spark):
    out = C.integer_vectors(frame(spark, vectors(20, 4)), 4, 1024, "vec_id", "embedding")
    plan = out.select(C.nearest(out["v"], [[1, 2, 3, 4], [0, 0, 0, 0]]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
