"""Sorting, limits and pages.

A page is ``orderBy(...).offset(m).limit(n)``, which Catalyst plans as a
single ``TakeOrderedAndProject`` (per-partition top-(m+n), then a merge):
no full sort and no shuffle of the table. Deep pages use a keyset filter
instead of a growing offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import order_spec
from ..session import ensure_checkpoint_dir

DEFAULT_LIMIT = 10


def page(df: DataFrame, order: Sequence[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One page of an ordered result (LIMIT n OFFSET m)."""
    if limit is None or limit <= 0:
        raise ValueError("limit must be positive")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(int(offset))
    return out.limit(int(limit))


def keyset_page(df: DataFrame, sort_col: str, direction: str, after_value, after_id,
                limit: int = DEFAULT_LIMIT, id_col: str = "id") -> DataFrame:
    """Next page after (after_value, after_id) for deep paging; ``after_id=None`` starts at the first row.

    The filter is a plain comparison, so it prunes row groups at the scan,
    and the top-k buffer stays ``limit`` rows however deep the page is.
    Null sort values come first under DESC and last under ASC, as in
    ``order_spec``; ``after_value=None`` is a cursor inside them.
    """
    c, i = F.col(sort_col), F.col(id_col)
    down = direction.upper() == "DESC"
    order = [c.desc_nulls_first() if down else c.asc_nulls_last(), i.asc()]
    if after_id is None:
        return df.orderBy(*order).limit(int(limit))
    if after_value is None:
        cond = c.isNull() & (i > F.lit(after_id))
        cond = cond | c.isNotNull() if down else cond
    else:
        cond = (c < F.lit(after_value)) if down else (c > F.lit(after_value))
        cond = cond | ((c == F.lit(after_value)) & (i > F.lit(after_id)))
        cond = cond if down else cond | c.isNull()
    return df.where(cond).orderBy(*order).limit(int(limit))


ROWS_PER_RANGE = 1_000_000


def deep_page(df: DataFrame, sort_col: str, direction: str = "DESC", limit: int = DEFAULT_LIMIT, offset: int = 0,
              id_col: str = "id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The page of ``page`` at any offset, by distributed selection (``id_col`` is unique and not null).

    The sort keys alone are dealt into ranges of about ``rows_per_range`` rows and landed; the sizes of the ranges tell
    which of them hold the ranks ``offset + 1 .. offset + limit``. Only those are sorted, so a task holds a range and not
    ``offset + limit`` rows, and the driver one number a range. Ties are dealt on by id, so a sort value that most rows
    share fills several ranges. The rows themselves are fetched for the page only.
    """
    if limit is None or limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    ensure_checkpoint_dir(df.sparkSession)
    order = order_spec(sort_col, direction, tie_break=id_col)
    keys = df.select(*dict.fromkeys([sort_col, id_col]))
    ranges = max(1, -(-keys.count() // int(rows_per_range)))
    dealt = keys.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    wanted, before, first = [], 0, None
    for number, n in sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()):
        if before < offset + limit and before + n > offset:
            first = before if first is None else first
            wanted.append(number)
        before += n
    if not wanted:
        return df.limit(0)
    found = page(dealt.where(F.col("__range").isin(wanted)).drop("__range"), order, limit, offset - first).checkpoint()
    return in_page_order(of_page(df, id_col, found, limit, id_col), order, limit)


def page_info(df: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0,
              count_expr: Column | None = None) -> DataFrame:
    """One-row paging summary: total, total_pages, current_page, limit, offset.

    ``count_expr`` overrides ``count(*)`` (e.g. ``count(distinct id)``).
    The count is a partial (map-side) aggregate, so only one number per
    partition crosses the shuffle.
    """
    cnt = count_expr if count_expr is not None else F.count(F.lit(1))
    total = df.agg(cnt.cast("bigint").alias("total"))
    return total.select(
        F.col("total"),
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"),
        (F.floor(F.lit(offset) / F.lit(limit)) + 1).cast("bigint").alias("current_page"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(offset).cast("bigint").alias("offset"),
    )


def page_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column],
                 limit: int = DEFAULT_LIMIT, offset: int = 0, rank_col: str = "rank_in_key") -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of every key's ordered group.

    ``row_number() <= k`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so each map task forwards at most ``offset+limit``
    rows per key: a key holding a third of the table still ships only a
    few rows per task to the window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    hi = int(offset) + int(limit)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
              .where((F.col(rank_col) > int(offset)) & (F.col(rank_col) <= hi)))


# A page of at most this many rows is broadcast to the tables it is joined with; a larger one is joined by key.
BROADCAST_PAGE = 10_000


def page_rows(df: DataFrame, order: Sequence[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """The rows of one page, found in one scan and kept by a checkpoint.

    Every task keeps its first ``offset + limit`` rows and one merges them;
    nothing passes through the driver. All later joins read the page's
    rows from the checkpoint instead of finding them again.
    """
    return page(df, order, limit, offset).checkpoint()


def of_page(child: DataFrame, child_fk: str, rows: DataFrame, limit: int, key_col: str = "id") -> DataFrame:
    """Rows of ``child`` whose ``child_fk`` is a ``key_col`` of a page of at most ``limit`` rows (null keys match
    nothing). The child table is read in parallel, and is not shuffled while the page is small enough to broadcast."""
    ks = rows.select(F.col(key_col).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    ks = F.broadcast(ks) if limit <= BROADCAST_PAGE else ks
    return child.join(ks, child[child_fk] == F.col("__k"), "left_semi")


def in_page_order(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Order a page of at most ``limit`` rows: a top-k, without the sampling job and shuffle of a global range sort."""
    return df.orderBy(*order).limit(int(limit))
