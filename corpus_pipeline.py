"""Corpus pipeline: quality rules, SimHash near-duplicates, paragraph deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read back as the
next one's ``docs``. All stages but the last return the columns of ``docs``, whatever their names (dots, names that the
operators use inside); the last reads doc_id and text alone.

Defined results: a null or empty text is rejected by the quality rules, as it has no words; of near copies the row with
the smallest id stays (a null id only if all are null; of repeated rows one); very long texts are treated whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopframe.llm.common import land, read_table
from shopframe.llm.packing import pack_documents
from shopframe.llm.paragraphs import paragraph_dedup
from shopframe.llm.quality import quality_rules
from shopframe.llm.simhash import one_of_each_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality_rules(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (4-word shingles, 4 bits)."""
    return one_of_each_group(docs, shingle=4, max_bits=4)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text freed of paragraphs that another place keeps; n_chars follows the text."""
    out = paragraph_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining texts in sequences of at most 1024 tokens, with a checksum of their ids."""
    out = pack_documents(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset", "sequence_length")


STAGES = [("quality_rules", quality), ("simhash", near_duplicates), ("substring_dedup", substrings),
          ("packing", packed)]

# SQL has neither the tokenizer nor XXH64; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
