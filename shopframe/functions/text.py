"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 200


def preview(col: str | Column, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus ``...`` when longer; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit(""))))


def file_extension(col: str | Column) -> Column:
    """Lower-cased extension including the dot ('' when there is none)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))
