"""Connected components of an undirected edge list, and hot-bucket-safe linking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node of the class.

    Alternating large-star and small-star steps: each step needs one aggregation (a minimum per node, combined
    before the shuffle) and one join of the edges with those minima, so a node with very many edges is never
    gathered in one group. Every round is landed; only two numbers per round reach the driver. Self links
    and null ends are ignored; an empty list gives an empty result.
    """
    ab = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = land(ab, "cc")
    before = _signature(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, "a").where("b > a and b <> m")
                 .select(F.col("m").alias("a"), "b").distinct())
        # every edge is (smaller, larger): hang all smaller neighbours of b, and b, below the smallest one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select("a", "b", "m")
                 .select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
                 .where("a <> b").select("a", "b").distinct())
        now = land(small, "cc")
        after = _signature(now)
        if after == before:
            break
        before = after
    star = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return star.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
