"""Filter building blocks.

Every function returns a ``Column`` or a DataFrame built from built-in
expressions, so predicates stay inside whole-stage codegen and simple
comparisons reach the parquet scan as pushed filters.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- F2 / F3 / F4
def where_all(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    """AND together the conditions that are present; none present = no filter."""
    terms = [c for c in conditions if c is not None]
    if not terms:
        return df
    return df.where(functools.reduce(lambda a, b: a & b, terms))


def eq_if(col: str | Column, value) -> Column | None:
    """``col = value`` only when a value was given (optional equality term)."""
    if value is None or value == "":
        return None
    return _c(col) == F.lit(value)


def between_if(col: str | Column, low=None, high=None) -> Column | None:
    """Inclusive range with independently optional bounds."""
    terms = []
    if low is not None:
        terms.append(_c(col) >= F.lit(low))
    if high is not None:
        terms.append(_c(col) <= F.lit(high))
    if not terms:
        return None
    return functools.reduce(lambda a, b: a & b, terms)


# ---------------------------------------------------------------- F5
def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(text: str | None, cols: Sequence[str | Column], escape: bool = False) -> Column | None:
    """Case-blind substring match OR'ed over several columns.

    By default ``%`` and ``_`` typed by the user act as wildcards, as in the
    source model; ``escape=True`` matches them literally.
    """
    if not text:
        return None
    needle = escape_like(text) if escape else text
    pattern = f"%{needle}%"
    return functools.reduce(lambda a, b: a | b, [_c(c).ilike(pattern) for c in cols])


# ---------------------------------------------------------------- F6 / X14
def parse_flag(value) -> bool | None:
    """Only the text ``true`` is true; any other present value is false."""
    if value is None:
        return None
    return str(value) == "true"


def parse_int(value, default: int, zero_falls_back: bool = True) -> int:
    """``parseInt(x) || default``: unparsable (and 0) fall back to the default."""
    try:
        text = str(value).strip()
        sign = -1 if text.startswith("-") else 1
        digits = text.lstrip("+-")
        n = ""
        for ch in digits:
            if not ch.isdigit():
                break
            n += ch
        out = sign * int(n) if n else None
    except (TypeError, ValueError):
        out = None
    if out is None or (zero_falls_back and out == 0):
        return default
    return out


def parse_float(value, default: float = 0.0) -> float:
    """``parseFloat(x) || default``: leading numeric prefix, else the default."""
    if value is None:
        return default
    text = str(value).strip()
    best = None
    for end in range(len(text), 0, -1):
        try:
            best = float(text[:end])
            break
        except ValueError:
            continue
    if best is None or best == 0 or math.isnan(best):
        return default
    return best


# ---------------------------------------------------------------- F7
def visible_comments(df: DataFrame, viewer_role: str | None = None, status: str | None = None,
                     status_col: str = "status") -> DataFrame:
    """An admin who names a status sees that status; every other request
    (including an admin naming none) sees approved comments only."""
    if viewer_role == "admin" and status:
        return df.where(F.col(status_col) == F.lit(status))
    return df.where(F.col(status_col) == "approved")


# ---------------------------------------------------------------- F8
def id_or_name(value: str, id_col: str | Column = "id", name_col: str | Column = "en_name") -> Column:
    """Match a row whose id (as text) or name equals the given value."""
    return (_c(id_col).cast("string") == F.lit(value)) | (_c(name_col) == F.lit(value))


# ---------------------------------------------------------------- F9
def live(df: DataFrame, as_of, expires_col: str = "expires_at", revoked_col: str | None = None,
         attempts_col: str | None = None, max_attempts: int = 5) -> DataFrame:
    """Credentials still usable at ``as_of``: not expired (strict), not revoked,
    fewer than ``max_attempts`` attempts."""
    terms = [F.col(expires_col) > F.lit(as_of).cast("timestamp_ntz")]
    if revoked_col:
        terms.append(~F.coalesce(F.col(revoked_col), F.lit(False)))
    if attempts_col:
        terms.append(F.coalesce(F.col(attempts_col), F.lit(0)) < max_attempts)
    return where_all(df, terms)


# ---------------------------------------------------------------- F10
def check_allowed(value: str, allowed: Sequence[str], what: str, case_blind: bool = False) -> str:
    """Reject a value outside an allow-list before any plan is built."""
    probe = value.upper() if case_blind else value
    pool = [a.upper() for a in allowed] if case_blind else list(allowed)
    if probe not in pool:
        raise ValueError(f"Invalid {what}: {value!r}")
    return probe


# ---------------------------------------------------------------- F11 / F12
def find_conflicts(incoming: DataFrame, base: DataFrame, keys: Sequence[str],
                   incoming_id: str = "request_id", base_id: str = "id",
                   exclude_self: str | None = None) -> DataFrame:
    """Incoming rows that collide with a base row on *any* of ``keys``.

    One equi-join per key, unioned, instead of an OR join (which would be a
    nested-loop join). Output: (incoming_id, key, value, conflicting_id), one
    row per (request, key, base row). With ``exclude_self`` a base row whose
    ``base_id`` equals the incoming column ``exclude_self`` is not a conflict
    (F12: updating one's own email is not a clash).
    """
    parts = []
    for k in keys:
        left = incoming.where(F.col(k).isNotNull())
        right = base.select(F.col(base_id).alias("conflicting_id"), F.col(k).alias("_bk"))
        hit = left.join(right, left[k] == right["_bk"], "inner")
        if exclude_self:
            hit = hit.where(~F.col("conflicting_id").eqNullSafe(F.col(exclude_self)))
        parts.append(hit.select(F.col(incoming_id), F.lit(k).alias("key"),
                                F.col(k).cast("string").alias("value"), F.col("conflicting_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
