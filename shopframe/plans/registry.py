"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry derives the marketplace tables from a test-data directory and
runs one report or operator over the whole tables. Nested results are
flattened into counts and sorted id lists so they can be compared with the
SQL twins in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.fixtures import marketplace

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str):
    ensure_checkpoint_dir(spark)
    return marketplace(spark, sf_dir)


def load_all() -> dict[str, QueryFn]:
    # Importing the query modules fills REGISTRY.
    from . import queries, queries_changes, queries_kept, queries_streaming  # noqa: F401
    return dict(REGISTRY)
