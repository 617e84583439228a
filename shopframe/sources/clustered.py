"""Landing in an order that several range filters can skip by.

A table sorted by one column lets only filters on that column skip files. ``save_clustered`` gives every row the
interleaved bits of its places in all ``cols`` and deals rows by ranges of that number, so each file and row group covers
a small box of the columns, and Parquet's statistics let a scan with pushed-down filters on any of them skip the rest.
Places come from approximate quantiles, so uneven values still spread evenly; equal values always share a place, and a
very frequent one fills as many files as it needs, since rows of one number are dealt by a hash of the row as well.

Defined results: the rows are those of ``df``, whatever the columns hold; nulls stand before all values; an empty table
is written as such.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_BYTES = 7


def sort_number(df: DataFrame, col: str) -> Column:
    """A number in the order of the column: text by its first seven bytes, times by microseconds, days, or itself."""
    kind = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
        return F.conv(head, 16, 10).cast("long").cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"no order for column {col} of type {kind.simpleString()}")


def places(df: DataFrame, cols: Sequence[str], bits: int = 4) -> list[Column]:
    """For each column the place of its quantile range, below ``2**bits``. One aggregation finds the ``2**bits - 1``
    quantiles of each column, which are all that the driver sees."""
    shares = [i / 2 ** bits for i in range(1, 2 ** bits)]
    found = df.agg(*[F.percentile_approx(sort_number(df, c), F.lit(shares), 10000).alias(f"q{i}")
                     for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        value, cuts = sort_number(df, c), list(found[f"q{i}"] or [])
        steps = [value >= F.lit(q) for q in sorted(set(cuts))]
        steps += [value > F.lit(q) for q in sorted(set(cuts)) if cuts.count(q) > 1]  # a frequent value has its own place
        place = sum((F.coalesce(x.cast("long"), F.lit(0).cast("long")) for x in steps), F.lit(0).cast("long"))
        out.append(place * F.lit(2 ** bits // (len(steps) + 1)))  # few places use the highest bits
    return out


def interleaved(numbers: Sequence[str], bits: int) -> Column:
    """One number of the bits of the columns ``numbers``, highest bits first, the first column's bit leading each round."""
    z = F.lit(0).cast("long")
    for i, c in enumerate(numbers):
        for b in range(bits):
            bit = F.shiftright(F.col(c), b).bitwiseAND(F.lit(1).cast("long"))
            z = z + F.shiftleft(bit, b * len(numbers) + len(numbers) - 1 - i)
    return z


def save_clustered(df: DataFrame, path: str, cols: Sequence[str], files: int, bits: int = 4) -> DataFrame:
    """Write ``df`` below ``path`` in about ``files`` files clustered by ``cols`` and return it as read back."""
    if not cols or bits < 1 or bits * len(cols) > 62:
        raise ValueError("one column at least, and at most 62 bits in all")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    names = [f"p{i}" for i in range(len(cols))]
    placed = df.select(row.alias("row"), F.xxhash64(row).alias("h"),
                       *[p.alias(n) for n, p in zip(names, places(df, cols, bits))])
    (placed.select("row", "h", interleaved(names, bits).alias("z"))
     .repartitionByRange(int(files), "z", "h").sortWithinPartitions("z", "h").select("row.*")
     .write.mode("overwrite").parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
