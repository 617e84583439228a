"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt evenly to shards of about ``shard_rows`` rows, and each shard becomes a landed KD-tree: the widest
dimension is split at its median until a leaf holds LEAF rows, and every node keeps the tight bounding box of its rows.
The largest inner product that a box allows is the sum over the dimensions of the larger of q * low and q * high.
Queries come in blocks. A block first searches one shard; the kth score found there bounds its search of all shards,
which visits boxes best first and stops at boxes that cannot reach the kth score any more. Of equal scores a shard keeps
the smaller ids, so it returns k rows a query however many copies it holds, and the result is exact.

Components are scaled and floored in double precision, which is exact for them. Products use matrix routines while all
sums stay below 2^53, and integers of any size otherwise; a score beyond 64 bits counts as the nearest long.

Defined results: a vector that is null or has a null, infinite or NaN component takes no part, nor has a null id; only
vectors of as many components are compared; a row never is a candidate for a query of the same id; rows that repeat
are candidates, and queries, each; fewer candidates than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import land, ship_package

SCALE = 1024
SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
LEAF = 64
TREE = "part int, dim int, ids binary, vectors binary, boxes binary"


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def scaled(vectors, dim: int, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), dim))


def nodes_of(n: int, leaf: int = LEAF) -> list[tuple[int, int, bool]]:
    """(first row, end, is leaf) of the nodes of a balanced tree over n rows; node i has the children 2i+1, 2i+2."""
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    level, out = [(0, n)], []
    for d in range(depth + 1):
        out += [(a, b, d == depth) for a, b in level]
        level = [x for a, b in level for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return out


def build_tree(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and vectors in leaf order, and the (low, high) box of every node."""
    order = np.arange(len(ids))
    nodes = nodes_of(len(ids))
    boxes = np.zeros((len(nodes), 2, x.shape[1]))
    for i, (a, b, leaf) in enumerate(nodes):
        rows = x[order[a:b]]
        if len(rows):
            boxes[i] = rows.min(axis=0), rows.max(axis=0)
        if not leaf and b - a > 1 and x.shape[1]:
            widest = int(np.argmax(boxes[i, 1] - boxes[i, 0]))
            order[a:b] = order[a:b][np.argpartition(rows[:, widest], (b - a) // 2)]
    return ids[order], x[order], boxes


def _exact(*arrays: np.ndarray) -> bool:
    """Whether every partial sum of products fits the 53 bits of a double."""
    top = [float(np.abs(a).max(initial=0)) for a in arrays]
    return top[0] * top[1] * max(1, arrays[0].shape[-1]) < 2 ** 53


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _as_longs(scores: np.ndarray) -> np.ndarray:
    """Exact integers beyond 64 bits become the nearest long."""
    return np.minimum(np.maximum(scores, -2 ** 63), 2 ** 63 - 1) if scores.dtype == object else scores


def search_tree(tree, query_ids, queries, bounds, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query the first k (score, id) in the tree that reach its bound, equal scores by the smaller id."""
    ids, x, boxes = tree
    if not _exact(x, queries):
        x, boxes, queries = _integers(x), _integers(boxes), _integers(queries)
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    reach = _as_longs(positive @ boxes[:, 1].T + negative @ boxes[:, 0].T)
    nodes = nodes_of(len(ids))
    for i, q in enumerate(queries):
        kth, found = bounds[i], []  # found: (-score, id), at most k
        heap = [(-reach[i, 0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            a, b, leaf = nodes[node]
            if not leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    if reach[i, child] >= kth and nodes[child][0] < nodes[child][1]:
                        heapq.heappush(heap, (-reach[i, child], child))
                continue
            s = _as_longs(x[a:b] @ q)
            take = np.flatnonzero((s >= kth) & (ids[a:b] != query_ids[i]))
            if len(take):
                found = heapq.nsmallest(k, found + [(-int(v), int(c)) for v, c in zip(s[take], ids[a:b][take])])
                if len(found) == k:
                    kth = max(kth, -found[-1][0])
        yield i, [(-v, c) for v, c in found]


def _packed(rows: DataFrame, parts: int, with_boxes: bool) -> DataFrame:
    """The rows dealt evenly to ``parts`` parts, one packed row for each part and number of components."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        got = [f for f in frames if len(f)]
        if not got:
            return
        frame = pd.concat(got)
        size = frame["v"].map(len)
        for dim, group in frame.groupby(size):
            ids, x = group["id"].to_numpy(np.int64), scaled(group["v"], int(dim))
            boxes = np.zeros(0)
            if with_boxes:
                ids, x, boxes = build_tree(ids, x)
            yield pd.DataFrame([(part, int(dim), ids.tobytes(), x.tobytes(), boxes.tobytes())],
                               columns=["part", "dim", "ids", "vectors", "boxes"])

    return rows.repartition(parts).mapInPandas(pack, TREE)


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(block, dim, at, query_id, vec_id, score) of pairs of a query block and a tree."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ids, qids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                tree = (ids, np.frombuffer(r.vectors).reshape(len(ids), r.dim),
                        np.frombuffer(r.boxes).reshape(len(nodes_of(len(ids))), 2, r.dim))
                bounds = [-math.inf] * len(qids)
                if r.bounds is not None:
                    for known in r.bounds:
                        bounds[known["at"]] = known["score"]
                queries = np.frombuffer(r.q_vectors).reshape(len(qids), r.dim)
                rows = [(r.block, r.dim, i, int(qids[i]), c, s)
                        for i, best in search_tree(tree, qids, queries, bounds, k) for s, c in best]
                yield pd.DataFrame(rows, columns=["block", "dim", "at", "query_id", "vec_id", "score"])

    return pairs.select("block", "dim", "ids", "vectors", "boxes", "q_ids", "q_vectors", "bounds").mapInPandas(
        search, "block int, dim int, at int, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "dim", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest integer inner products for each row that
    ``is_query`` selects, ties to the smaller id."""
    ship_package(rows.sparkSession)
    n, n_queries = valid_vectors(rows, id_col, vector_col).agg(F.count("*")).first()[0], \
        valid_vectors(rows.where(is_query), id_col, vector_col).agg(F.count("*")).first()[0]
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    trees = land(_packed(valid_vectors(rows, id_col, vector_col), shards, True), "kd-trees")
    queries = land(_packed(valid_vectors(rows.where(is_query), id_col, vector_col), blocks, False)
                   .select(F.col("part").alias("block"), "dim", F.col("ids").alias("q_ids"),
                           F.col("vectors").alias("q_vectors")), "query-blocks")
    none = F.lit(None).cast("array<struct<at int, score long>>")
    home = queries.withColumns({"part": F.pmod("block", F.lit(shards)), "bounds": none})
    first = _best(_searched(home.join(trees, ["part", "dim"]), k), k)
    # a query with fewer than k candidates at home has no bound yet
    kth = (first.where(F.col("rank") == k).groupBy("block", "dim")
           .agg(F.collect_list(F.struct("at", "score")).alias("bounds")))
    every = land(queries.join(kth, ["block", "dim"], "left"), "bounded-blocks").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = _searched(every.join(trees, ["part", "dim"]), k)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
