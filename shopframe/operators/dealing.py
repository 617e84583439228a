"""Shuffles whose tasks hold a bounded number of rows.

After a shuffle Spark joins partitions until about one a core is left, or until one holds the advised size. It counts
compressed bytes: keys that shrink twentyfold come to one task by the million, and a table of keys that looks small on
disk is broadcast whole. A number of partitions that is asked for by name is left as it is, so it is taken from the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_TASK = 500_000  # narrow rows that one task sorts or joins


def row_counts(frames: Sequence[DataFrame]) -> list[int]:
    """The number of rows of every frame, in one job; a scan's count is read from the files' footers."""
    out = None
    for i, df in enumerate(frames):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n")
        out = one if out is None else out.unionByName(one)
    return [r["n"] for r in sorted(out.collect(), key=lambda r: r["i"])]


def tasks_for(rows: int, rows_a_task: int | None = None) -> int:
    """Tasks for so many rows, 0 if they are few enough for one, where Spark's own choice stays."""
    most = rows_a_task or ROWS_A_TASK
    return -(-rows // most) if rows > most else 0


def deal(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt to ``tasks`` tasks by its keys, or as it is without a number."""
    return df.repartition(tasks, *keys) if tasks else df


def held_by(df: DataFrame, tasks: int, key: str) -> DataFrame:
    """``df`` dealt and sorted by ``key`` once and held on the executors' disks, for a job that joins it by that key many
    times: joins of two frames held by as many tasks, and groups by the key, need no shuffle. Whoever calls it unpersists."""
    return hold(deal(df, tasks, key).sortWithinPartitions(key))


def hold(df: DataFrame) -> DataFrame:
    """``df`` computed now and held on the executors' disks, dealt and sorted as it is. A query that reads a frame twice
    before it is held would run a job for each."""
    held = df.persist(StorageLevel.DISK_ONLY)
    held.count()
    return held


def key_join(left: DataFrame, keys: DataFrame, on: str, key: str, how: str, n_left: int, n_keys: int) -> DataFrame:
    """``left`` joined with ``keys`` on one column of each, given how many rows they have. Few keys are broadcast, many
    are dealt like the rows; two small sides are left to Spark. A semi or anti join would be moved below the dealing, so
    it is written as a join with the distinct keys there."""
    tasks = tasks_for(max(n_left, n_keys))
    same = F.col(on) == F.col(key)
    if not tasks or not tasks_for(n_keys):
        return left.join(F.broadcast(keys) if tasks else keys, same, how)
    left, keys = deal(left, tasks, on), deal(keys, tasks, key)
    if how == "inner":
        return left.join(keys.hint("merge"), same)
    keys = keys.distinct().hint("merge")  # already dealt by the key
    if how == "left_semi":
        return left.join(keys, same).drop(key)
    if how == "left_anti":
        return left.join(keys, same, "left").where(F.col(key).isNull()).drop(key)
    raise ValueError(f"unknown join {how}")
