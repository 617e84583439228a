"""Sort expressions.

The source database puts nulls first on DESC and last on ASC and orders
enums by declaration; Spark defaults differ on both, so every sort built
here spells the null placement out, ranks enum columns, and ends with a
unique key so paging is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import check_allowed


def enum_rank(col: str | Column, domain: Sequence[str]) -> Column:
    """1-based declaration position of an enum value (null stays null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.array_position(F.array(*[F.lit(v) for v in domain]), c))


def sort_key(col: str | Column, direction: str = "DESC", enum_domain: Sequence[str] | None = None) -> Column:
    """One sort key with source-database null placement."""
    direction = check_allowed(direction, ["ASC", "DESC"], "sort order", case_blind=True)
    c = F.col(col) if isinstance(col, str) else col
    if enum_domain is not None:
        c = enum_rank(c, enum_domain)
    return c.desc_nulls_first() if direction == "DESC" else c.asc_nulls_last()


def order_spec(sort_by: str, direction: str = "DESC", allowed: Sequence[str] | None = None,
               tie_break: str | Sequence[str] = "id", enums: dict[str, Sequence[str]] | None = None,
               prefix: str = "") -> list[Column]:
    """Allow-listed dynamic sort (L1) plus ascending key tie-break.

    ``enums`` maps column names to their declared domains (L6) so that a sort
    on ``status`` or ``role`` follows declaration order, not text order.
    """
    if allowed is not None:
        check_allowed(sort_by, allowed, "sort field")
    enums = enums or {}
    keys = [sort_key(prefix + sort_by, direction, enums.get(sort_by))]
    ties = [tie_break] if isinstance(tie_break, str) else list(tie_break)
    keys += [F.col(prefix + t).asc_nulls_last() for t in ties if t != sort_by]
    return keys


def multi_order(*pairs: tuple[str, str], tie_break: str | None = "id") -> list[Column]:
    """Fixed multi-key sort (L4), e.g. ``("is_default","DESC"), ("created_at","DESC")``."""
    keys = [sort_key(c, d) for c, d in pairs]
    if tie_break:
        keys.append(F.col(tie_break).asc_nulls_last())
    return keys
