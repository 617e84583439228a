"""Typed scans, versioned sinks and JSON export.

Tables are landed as parquet (one directory per table). Parquet has no
MERGE, so a changed table is written as a new version directory; readers
keep reading the version they started with and a retried write of the same
version overwrites only its own directory (idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES


def load_table(spark: SparkSession, root: str, name: str, declared: bool = False,
               key_type: T.DataType | None = None) -> DataFrame:
    """Scan ``root/name`` (parquet).

    ``declared=True`` reads with the declared schema of ``schemas.TABLES``
    (no inference; with ``key_type`` replacing the string key type, e.g.
    ``LongType()`` for integer-keyed landings). Column pruning and filter
    pushdown apply either way because the scan stays a plain parquet read.
    """
    reader = spark.read
    if declared:
        schema = TABLES[name]
        if key_type is not None:
            schema = T.StructType([
                T.StructField(f.name, key_type if (f.name == "id" or f.name.endswith("_id"))
                              and isinstance(f.dataType, T.StringType) else f.dataType, f.nullable)
                for f in schema.fields])
        reader = reader.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}")


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Land ``df`` as a table bucketed and sorted by ``key`` at ``path``.

    Two tables bucketed on their join key with the same bucket count join
    without an exchange on either side (sort-merge within buckets), e.g.
    order lines and orders on the order id. Returns the table for reading.
    The bucket spec lives in the session catalog, so readers must go through
    ``spark.table(name)`` (a plain parquet read of ``path`` loses it); on a
    cluster use a persistent catalog so every job sees it.
    """
    (df.write.mode("overwrite").option("path", path)
       .bucketBy(int(buckets), key).sortBy(key).saveAsTable(table))
    return df.sparkSession.table(table)


def version_path(base: str, version: int | str) -> str:
    return f"{base.rstrip('/')}/v={version}"


def write_version(df: DataFrame, base: str, version: int | str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as version ``version`` of the table at ``base``.

    Overwrites only ``base/v=<version>``, so a retried batch rewrites the
    same files and never touches a version someone may be reading.
    """
    path = version_path(base, version)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: int | str) -> DataFrame:
    return spark.read.parquet(version_path(base, version))


def append(df: DataFrame, path: str, batch: str | int) -> DataFrame:
    """``INSERT .. RETURNING *`` — append rows under a batch key and return them as they were written.

    The rows go to ``path/batch=<batch>``. The writer's success marker, which comes last, says that a batch is whole: a
    batch that is appended again is not written again but read back, one that died earlier is overwritten. So a retry
    adds nothing and returns the same rows, even if ``df`` would come out otherwise the second time.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch={batch}")
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(folder.toString())
    return spark.read.schema(df.schema).parquet(folder.toString())


def to_documents(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON envelope ``{"success": true, "data": {...}}`` per row.

    Nulls are written as ``null`` (``ignoreNullFields=false``) so absent
    and null fields stay distinguishable, as in the source's responses.
    """
    payload = F.struct(F.lit(True).alias("success"), F.struct(*[F.col(c) for c in df.columns]).alias("data"))
    cols = [F.col(key)] if key else []
    return df.select(*cols, F.to_json(payload, {"ignoreNullFields": "false"}).alias("document"))
