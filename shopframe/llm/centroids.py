"""Centroid clustering (Lloyd's rounds over integer vectors) in expressions of the JVM.

The kept vectors become arrays of integers and are landed once. In a round the centroids are literals of the plan:
zip_with and aggregate give the squared distance to each, array_min over (distance, number) structs chooses the
cluster, and one sum column a component, combined inside every task before the shuffle, gives the next centroids. So
a round shuffles at most one row a cluster and task, and the driver sees one row a cluster. The number of rounds and
of clusters are parameters, no row is cached on an executor, and a lost one costs the tasks it ran.

Defined results: a vector that is null, has another number of components than ``dim``, or a null, infinite or NaN
component takes no part; a component beyond +-2^27 after scaling counts as that limit, so that every distance fits a
long; rows that repeat are vectors each; a null id is kept (it starts no centroid while others can). Equal hashes of
repeated ids are ordered by the vector. Equal distances go to the smaller number; an empty cluster keeps its centroid;
with fewer vectors than ``clusters`` each starts one; an empty table gives an empty result; extra columns are not
read. Sums beyond a long (inertia) count as the nearest long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

LIMIT = 1 << 27
LONG_MAX = (1 << 63) - 1


def integer_vectors(rows: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the kept rows with floor(scale * x) of every component x, as longs."""
    vector = F.col(vector_col)
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.least(F.greatest(y, F.lit(-LIMIT).cast("long")), F.lit(LIMIT).cast("long"))

    kept = F.coalesce((F.size(vector) == dim) & good, F.lit(False))
    return rows.where(kept).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, whole).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of "<seed>:<id>", in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters)
    return [list(r.v) for r in first.collect()]


def long_array(values: list[int]) -> Column:
    """A literal array of longs, in one expression."""
    return F.expr(f"array({','.join(f'{int(v)}L' for v in values)})")


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest of the literal centroids, ties to the smaller number."""
    def distance(centroid: list[int]) -> Column:
        squares = F.zip_with(vector, long_array(centroid), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def next_centroids(vectors: DataFrame, centroids: list[list[int]], wide: bool) -> list[list[int]]:
    """One round: the floored mean of every cluster's vectors; an empty cluster's centroid as it was."""
    kind = "decimal(20,0)" if wide else "long"
    component = [F.expr(f"sum(cast(get(v, {i}) AS {kind})) AS s{i}") for i in range(len(centroids[0]))]
    sums = (vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v").groupBy("cluster")
            .agg(F.count("*").alias("n"), *component))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # at most one row a cluster
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(len(centroids[0]))]
    return out


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def centroid_clusters(rows: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024,
                      seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector, after ``rounds`` rounds and a
    last assignment. ``centroid`` is the array of its cluster's components, ``distance`` the squared one to it."""
    if clusters < 1 or dim < 1 or rounds < 0:
        raise ValueError("clusters and dim must be positive, rounds not negative")
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    vectors = land(integer_vectors(rows, dim, scale, id_col, vector_col), "integer-vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
                       .alias("top")).first()
    wide = size["n"] * max(size["top"], 1) > LONG_MAX
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids, wide)
    found = vectors.select("id", nearest(F.col("v"), centroids).alias("best"))
    found = land(found.select("id", "best.cluster", "best.distance"), "assigned-vectors")
    totals = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}

    def of_cluster(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("cluster"))

    inertia = [F.lit(min(totals.get(i, 0), LONG_MAX)).cast("long") for i in range(len(centroids))]
    literals = [long_array(centroid) for centroid in centroids]
    return found.select("id", "cluster", "distance", of_cluster(inertia).alias("cluster_inertia"),
                        F.lit(min(sum(totals.values()), LONG_MAX)).cast("long").alias("inertia"),
                        of_cluster(literals).alias("centroid"))
