"""Registered queries over embeddings and token files: hard negatives, token files and clusters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import centroid_clusters
from .common import read_table
from .hard_negatives import hard_negatives
from .token_files import round_trip

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


@query("op13_centroid_clusters")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every 64-component vector after ten rounds from eight centroids."""
    out = centroid_clusters(read_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dim=64, scale=1024, seed=3)
    digits = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                      F.sha2(digits, 256).alias("centroid_sha256"))


def _clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """One pair of CTEs a round: the nearest centroid of every vector, then the floored means."""
    assign = """a{n} AS MATERIALIZED (
  SELECT vec_id, pos, e, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
    SELECT v.vec_id, v.pos, v.e, m.c,
           CAST(list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v, m{n} m) GROUP BY vec_id, pos, e)"""
    move = """s{n} AS MATERIALIZED (
  SELECT c, i, CAST(sum(e[i]) AS BIGINT) AS total, count(*) AS n FROM a{p}, range(1, 65) r(i) GROUP BY c, i),
m{n} AS MATERIALIZED (
  SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY i) AS e FROM s{n} GROUP BY c
  UNION ALL SELECT c, e FROM m{p} WHERE c NOT IN (SELECT c FROM s{n}))"""
    steps = [assign.format(n=0, k=clusters)]
    for n in range(1, rounds + 1):
        steps += [move.format(n=n, p=n - 1), assign.format(n=n, k=clusters)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS pos,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS INTEGER) AS c, e FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {clusters})),
{",".join(steps)},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS total FROM a{rounds} GROUP BY c),
h AS (SELECT c, sha256(array_to_string(list_transform(e, lambda x: CAST(x AS VARCHAR)), ',')) AS s FROM m{rounds})
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, t.total AS cluster_inertia,
       (SELECT CAST(sum(total) AS BIGINT) FROM t) AS inertia, h.s AS centroid_sha256
FROM a{rounds} a JOIN t ON t.c = a.c JOIN h ON h.c = a.c
"""


ORACLE["op13_centroid_clusters"] = _clusters_sql()


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of other labels between 30 and 90 per cent of the score of each of an anchor's five best rows
    of its own label; anchors are the vectors whose id is divisible by 100."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved, positives=5, k=10, low=30,
                          high=90, scale=256)


ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id AND len(a.e) = len(r.e) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same)
  WHERE n <= 5),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM w WHERE rank <= 10
"""


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the token files."""
    return round_trip(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
