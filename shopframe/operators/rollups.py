"""Kept sales sums per product, changed by signed deltas.

A seller report needs, of the order lines, only a few sums per product. They are kept in a table of key buckets
(``sources.buckets``), and every change of orders adds signed sums to it: placed lines count up, lines of deleted orders
count down, and a status that turns to or from cancelled moves its lines between the two. All sums are integers or exact
decimals, so the table equals the full recomputation after any sequence of changes, in any order of the batches.

Defined results: a line without an order is not counted, as in the reports; a null product is a key like any other; a
null quantity or price counts as 0; an order without a status counts as cancelled, as the best sellers leave it out; a
product whose last line goes has no row; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import BucketedTable
from .metrics import OUT_MONEY, line_value

KEY = "product_id"
SUMS = ["n_items", "units", "revenue", "cancelled_items", "cancelled_units"]


def _sums(lines: DataFrame, sign: int = 1, moved: bool = False) -> DataFrame:
    """One row of signed sums for every product of ``lines(product_id, quantity, price_at_time, status)``. With
    ``moved`` only the cancelled parts change. Partial aggregation in the map tasks bears a hot product."""
    zero = F.lit(0).cast("bigint")
    units = F.coalesce(F.col("quantity").cast("bigint"), zero)
    money = F.coalesce(line_value(), F.lit(0)).cast(OUT_MONEY)
    way = F.lit(sign).cast("bigint") * (F.col("way").cast("bigint") if moved else F.lit(1))
    cancelled = F.lit(True) if moved else F.coalesce(F.col("status") == "cancelled", F.lit(True))
    none = F.lit(0).cast(OUT_MONEY)
    return lines.groupBy(KEY).agg(
        F.sum(zero if moved else way).alias("n_items"),
        F.sum(zero if moved else way * units).alias("units"),
        F.sum(none if moved else (money if sign > 0 else -money)).cast(OUT_MONEY).alias("revenue"),
        F.sum(F.when(cancelled, way).otherwise(zero)).alias("cancelled_items"),
        F.sum(F.when(cancelled, way * units).otherwise(zero)).alias("cancelled_units"))


def _of_orders(order_items: DataFrame, orders: DataFrame, *cols: str, on: tuple[str, str] = ("order_id", "id")) -> DataFrame:
    """Lines with columns of their order; a line without an order is left out."""
    o = orders.select(F.col(on[1]).alias("__oid"), *cols)
    return order_items.join(o, F.col(on[0]) == F.col("__oid")).select(KEY, "quantity", "price_at_time", *cols)


def sales_sums(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """The sums of all lines: what the kept table starts with, and what it must equal at any time."""
    return _sums(_of_orders(order_items, orders, "status"))


def placed_deltas(orders: DataFrame, order_items: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Deltas of the orders and lines that a batch of placements created (``changes.place_orders``). With ``doc_id`` lines
    find their order by the document that both were made of, which their order ids are derived from."""
    return _sums(_of_orders(order_items, orders, "status", on=(doc_id, doc_id) if doc_id else ("order_id", "id")))


def deleted_deltas(orders: DataFrame, order_items: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deltas of the orders whose ``id`` stands in ``deleted`` (repeats count once). ``orders`` and ``order_items`` are
    the tables before the deletion; only the lines of deleted orders pass on."""
    gone = orders.join(deleted.select(F.col("id").alias("__gone")).distinct(), F.col("id") == F.col("__gone"), "left_semi")
    return _sums(_of_orders(order_items, gone, "status"), -1)


def status_deltas(before: DataFrame, after: DataFrame, order_items: DataFrame, changes: DataFrame,
                  order_col: str = "order_id") -> DataFrame:
    """Deltas of a batch of status changes: lines of orders that became cancelled, or no longer are. Only orders named
    in ``changes`` are compared, and only lines of those that flipped are read further."""
    named = changes.select(F.col(order_col).alias("__named")).distinct()

    def state(orders, name):
        return orders.select("id", F.coalesce(F.col("status") == "cancelled", F.lit(True)).cast("int").alias(name))

    old = before.join(named, F.col("id") == F.col("__named"), "left_semi")
    flipped = (state(old, "was").join(state(after, "now"), "id").where("was <> now")
               .select("id", (F.col("now") - F.col("was")).alias("way")))
    return _sums(_of_orders(order_items, flipped, "way"), moved=True)


def add_deltas(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    """Rows of kept sums with the deltas added; for ``BucketedTable.apply``."""
    total = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in SUMS]
    both = rows.select(KEY, *SUMS).unionByName(deltas.select(KEY, *SUMS))
    return both.groupBy(KEY).agg(*total).where("n_items <> 0")


class KeptSales:
    """The kept table of one folder: created once from all lines, then changed by one batch of deltas after another."""

    def __init__(self, table: BucketedTable):
        self.table = table

    @classmethod
    def create(cls, order_items: DataFrame, orders: DataFrame, root: str, buckets: int = 64) -> KeptSales:
        return cls(BucketedTable.create(sales_sums(order_items, orders), root, KEY, buckets))

    @classmethod
    def open(cls, spark, root: str) -> KeptSales:
        return cls(BucketedTable.open(spark, root))

    def add(self, deltas: DataFrame, batch_id: int) -> bool:
        """Add a batch, unless it was added before. The deltas are checkpointed, as they are read more than once."""
        return self.table.apply(deltas.checkpoint(), batch_id, add_deltas)

    def read(self) -> DataFrame:
        return self.table.read()
