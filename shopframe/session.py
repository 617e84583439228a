"""Spark session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. They are only made where neither the submitter nor the running session made them.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Settings of a local session of our own that cannot be made later.
LOCAL_CONF = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shopframe", extra: dict | None = None) -> SparkSession:
    """Return the running session as it is, or start one and make the base settings that it does not have.

    Values of ``spark-submit`` and the defaults file win. Only a local
    session started here that names no ``spark.checkpoint.dir`` gets a
    folder of its own for checkpoints.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config(map=LOCAL_CONF)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    given = spark.sparkContext.getConf()
    wanted = dict(BASE_CONF)
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in wanted.items():
        if not given.contains(k):
            spark.conf.set(k, v)
    if not given.contains("spark.checkpoint.dir") and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shopframe-ckpt-"))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, or else the one set on the running context."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables, placed under the shared checkpoint dir."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}"
