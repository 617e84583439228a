"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

WS = r"[\x20\x09-\x0D]"
NO_ID = 1 << 62
WS_CHARS = " \t\n\u000b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, unless their path already names it (as after
    ``spark-submit --py-files`` with PYTHONPATH, or in a cluster image). Called by operators that run Python."""
    package = Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if any(f.endswith(f"/{package.name}.zip") for f in sc.listFiles):
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    This cuts the lineage with one stored copy that every executor can read, so later readers neither
    recompute the input nor see another row order after a lost executor. Spark drops the write's shuffle files when
    it ends (they have no further reader). The folder is left to the owner of ``spark.checkpoint.dir`` to clean,
    like any checkpoint.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_document_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __k and __c, which tell documents apart: the id (of a null id, a hash of the text from NO_ID on, so
    that null ids come last) and a checksum of the text. Rows that repeat id and text are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_id = F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    return docs.withColumns({"__k": F.coalesce(F.col(id_col).cast("long"), no_id),
                             "__c": F.crc32(F.encode(text, "UTF-8"))})


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row, __text, __k, __c): every row as one struct, so that none of its columns can clash, its text and key."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return with_document_key(rows, "__id", "__text").drop("__id")


def separate_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keyed_rows`` where every row with a null id is a document of its own: __c numbers these rows. They are landed,
    so that all readers see the same numbers."""
    named = keyed_rows(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    others = keyed_rows(docs.where(F.col(id_col).isNull()), id_col, text_col)
    return named.unionByName(land(others.withColumn("__c", F.monotonically_increasing_id()), "rows-without-id"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda that names a column expression would
    evaluate it again for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
