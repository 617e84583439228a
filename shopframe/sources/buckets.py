"""Tables in key buckets whose changes rewrite only the buckets they touch.

A row's bucket is a hash of its key modulo a fixed number. Below the table's folder::

    rows/b=<bucket>/v=<version>/      the rows of a bucket as of the version that last changed it
    versions/v=<version>/             one small file: the batch that made the version, and where each bucket stands

A batch reads the buckets of its keys, writes them under the next version's number by dynamic partition overwrite, and
writes the version's file last. That file alone makes the version visible: a batch that dies earlier leaves the table
as it was, and its repetition overwrites the same folders. The file also names the batch, so a batch that is delivered
again after it was committed changes nothing, in a new driver as well. The files hold one row a bucket, which is all
that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, VERSION = "b", "v"


class BucketedTable:
    """One table; ``key`` is a column or a list of columns that tell its rows apart."""

    def __init__(self, spark: SparkSession, root: str, key: str | list[str], buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), int(buckets)
        self.key = [key] if isinstance(key, str) else list(key)

    @classmethod
    def create(cls, df: DataFrame, root: str, key: str | list[str], buckets: int = 64) -> BucketedTable:
        """Write ``df`` as version 0. The number of buckets stays; choose it for some 128 MB of rows in each."""
        if buckets < 1 or {BUCKET, VERSION} & set(df.columns):
            raise ValueError("at least one bucket, and no columns named b or v")
        table = cls(df.sparkSession, root, key, buckets)
        table._write(df, 0)
        table._commit(0, -1, list(range(table.buckets)), {}, df.schema.json())
        return table

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> BucketedTable:
        last = cls(spark, root, [], 1)._last()
        return cls(spark, root, list(last["key"]), last["buckets"])

    def bucket_of(self, key: list[str] | None = None) -> Column:
        """The bucket of a row whose key stands in the columns ``key``; types must be those of the table."""
        return F.pmod(F.xxhash64(*[F.col(c) for c in key or self.key]), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ reading
    def _last(self):
        """The newest version's file. Folders of versions are listed, not opened, to find it."""
        fs, path = self._fs(f"{self.root}/versions")
        found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path)
                 if s.getPath().getName().startswith(f"{VERSION}=")
                 and fs.exists(self._path(f"{s.getPath()}/_SUCCESS"))]
        return self.spark.read.parquet(f"{self.root}/versions/{VERSION}={max(found)}").first()

    def version(self) -> int:
        return self._last()["version"]

    def last_batch(self) -> int:
        """The number of the batch that made the newest version, -1 for the table as it was created."""
        return self._last()["batch_id"]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its buckets."""
        return self._rows(self._last(), buckets)

    def _rows(self, last, buckets: list[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType
        import json
        schema = StructType.fromJson(json.loads(last["schema"]))
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/rows/{BUCKET}={p['b']}/{VERSION}={p['v']}" for p in last["places"]
                 if p["rows"] and (wanted is None or p["b"] in wanted)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ changing
    def touched(self, changes: DataFrame, key: list[str] | None = None) -> list[int]:
        """The buckets of the changes' keys, at most as many as there are buckets."""
        return sorted(r["b"] for r in changes.select(self.bucket_of(key).alias("b")).distinct().collect())

    def apply(self, changes: DataFrame, batch_id: int, change: Callable[[DataFrame, DataFrame], DataFrame],
              key: list[str] | None = None, keep: int = 2) -> bool:
        """Replace the touched buckets' rows by ``change(rows, changes)``, unless the batch was applied before.

        ``changes`` is read more than once and must not differ between reads. ``change`` may add, alter and remove rows
        of the changes' keys only; a row that leaves its bucket is refused. Folders that none of the last ``keep``
        versions names are deleted. Returns whether anything was applied.
        """
        last = self._last()
        if batch_id <= last["batch_id"]:
            return False
        buckets, version = self.touched(changes, key), last["version"] + 1
        places = {p["b"]: (p["v"], p["rows"]) for p in last["places"]}
        if buckets:
            rows = change(self._rows(last, buckets), changes)
            self._write(rows, version, buckets)
        self._commit(version, batch_id, buckets, places, last["schema"])
        self.clean_up(keep)
        return True

    def _write(self, rows: DataFrame, version: int, buckets: list[int] | None = None) -> None:
        bucket = self.bucket_of()
        if buckets is not None:
            inside = bucket.isin(buckets)
            bucket = F.when(inside, bucket).otherwise(F.raise_error(F.lit("a changed row left its bucket")).cast("int"))
        (rows.withColumn(BUCKET, bucket).withColumn(VERSION, F.lit(version))
         .repartition(len(buckets) if buckets else self.buckets, BUCKET)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION)
         .parquet(f"{self.root}/rows"))

    def _commit(self, version: int, batch_id: int, buckets: list[int], places: dict, schema: str) -> None:
        counts = dict.fromkeys(buckets, 0)
        fs, _ = self._fs(self.root)
        written = [b for b in buckets if fs.exists(self._path(f"{self.root}/rows/{BUCKET}={b}/{VERSION}={version}"))]
        if written:
            paths = [f"{self.root}/rows/{BUCKET}={b}/{VERSION}={version}" for b in written]
            found = (self.spark.read.option("basePath", f"{self.root}/rows").parquet(*paths).groupBy(BUCKET).count())
            counts.update({r[BUCKET]: r["count"] for r in found.collect()})
        now = {**places, **{b: (version, n) for b, n in counts.items()}}
        row = (version, batch_id, self.buckets, self.key, schema, [(b, v, n) for b, (v, n) in sorted(now.items())])
        self.spark.createDataFrame([row], "version int, batch_id long, buckets int, key array<string>, schema string, "
                                   "places array<struct<b int, v int, rows long>>").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.root}/versions/{VERSION}={version}")

    def clean_up(self, keep: int = 2) -> int:
        """Delete versions older than the last ``keep`` and the bucket folders that only they name."""
        fs, path = self._fs(f"{self.root}/versions")
        names = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path)
                       if s.getPath().getName().startswith(f"{VERSION}="))
        old, new = names[:-max(1, keep)], names[-max(1, keep):]
        if not old:
            return 0
        read = {n: self.spark.read.parquet(f"{self.root}/versions/{VERSION}={n}").first()["places"] for n in names}
        used = {(p["b"], p["v"]) for n in new for p in read[n]}
        stale = {(p["b"], p["v"]) for n in old for p in read[n]} - used
        for b, v in stale:
            fs.delete(self._path(f"{self.root}/rows/{BUCKET}={b}/{VERSION}={v}"), True)
        for n in old:
            fs.delete(self._path(f"{self.root}/versions/{VERSION}={n}"), True)
        return len(stale)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p
