"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .html_render import with_visible_text
from .kdtree import top_k
from .licenses import license_scan
from .packing import pack_documents
from .paragraphs import paragraph_dedup
from .quality import quality_rules
from .queries_vectors import ORACLE as VECTOR_ORACLE, QUERIES as VECTOR_QUERIES
from .sentencepiece_fst import with_round_trip
from .simhash import simhash_components
from .suffix_index import suffix_dedup
from .warc import archive_and_index

QUERIES: dict = dict(VECTOR_QUERIES)
ORACLE: dict[str, str] = dict(VECTOR_ORACLE)


def query(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol, duplicate-line and repeated-window counts of every document, the base verdict, and the
    verdict of the Jensen-Shannon rules."""
    out = quality_rules(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "class_distance", "word_distance")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents packed into sequences of at most 1024 tokens."""
    out = pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset", "sequence_length")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document (4-word shingles) and its group at 4 differing bits or fewer."""
    out = simhash_components(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                      "component_id")


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after repeated paragraphs are removed: what was removed, which documents keep it, and a
    digest of the text that stays."""
    out = paragraph_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "bytes_removed", "kept_in", F.length("text").alias("chars_kept"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when each 200-byte string that also starts elsewhere is removed."""
    out = suffix_dedup(read_table(spark, sf_dir, "documents"), length=200)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_warc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all pages, written to WARC files, read back and merged in the order of URL key and time."""
    out = archive_and_index(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


ORACLE["op3_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, regexp_extract(url, '^[a-z]+://(www\.)?([^/?#]*)([^#]*)', 2) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*([?][^#]+)', 1) AS query
  FROM pages),
d AS (
  SELECT page_id, strlen(h) AS n, sha1(h) AS s,
         array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')'
           || CASE WHEN path = '' THEN '/' ELSE path END || query AS url_key FROM p),
m AS (SELECT s, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY s HAVING count(*) > 1)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
       CASE WHEN last IS NULL OR last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> d.page_id THEN last END AS refers_to, url_key,
       strftime(to_timestamp(1577836800 + d.page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM d LEFT JOIN m ON d.s = m.s AND n >= 1000
"""


@query("op9_topk_search")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every vector whose id is divisible by 100."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLE["op9_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every document."""
    out = license_scan(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
                      "score")


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    out = with_round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"),
                      F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The displayed text of every page."""
    out = with_visible_text(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", "visible_text", F.length("visible_text").alias("n_chars"),
                      F.size(F.split("visible_text", "\n", -1)).alias("n_lines"))
