"""Query registrations of kept structures: sales sums, the gram index and the clustered landing.

Each query builds its structure from the whole derived tables in a fresh folder below the session's checkpoint
directory, changes it by whole batches and reads the report from it; the SQL twins compute the same from scratch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.predicates import between_if, eq_if, where_all
from ..operators import changes as M
from ..operators import metrics as A
from ..operators import rollups as K
from ..operators.dealing import held_by, hold, row_counts, tasks_for
from ..operators.grams import GramIndex
from ..schemas import FOREIGN_KEYS
from ..session import scratch_path
from ..sources.clustered import save_clustered
from ..sources.tables import load_table
from .queries_changes import checked_orders
from .registry import register, tables


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------- A3 / A4 / A5 / A15 / A18 from M10, M21, M8
_ORDER_FKS = [(c, col, "shop_orders", a) for c, col, p, a in FOREIGN_KEYS if p == "orders"]


def _kept_sales(spark, sf_dir):
    """The tables and the kept sums after three batches: status changes, placed orders, deletion of the oldest ones."""
    t = tables(spark, sf_dir)
    tasks = tasks_for(max(row_counts([t["order_items"], t["shop_orders"]])))
    tasks = max(tasks, spark.sparkContext.defaultParallelism) if tasks else 0
    # Every batch joins lines, orders, changes or documents by the order: each is dealt by it once. Lines of no order count
    # nowhere and would all come to one task. The changes are derived first: ``spark.sql`` lets go of the frames it is given.
    changes = held_by(t["order_status_changes"], tasks, "order_id")
    lines = t["order_items"] = held_by(t["order_items"].where(F.col("order_id").isNotNull()), tasks, "order_id")
    before = t["shop_orders"] = held_by(t["shop_orders"], tasks, "id")
    held = [lines, before, changes]
    try:
        kept = K.KeptSales.create(lines, before, _folder(spark, "kept-sales"), buckets=16)
        moved = M.order_status_change(before, lines, t["products"], t["sellers"], changes)
        orders = held_by(moved["orders"], tasks, "id")
        held.append(orders)
        kept.add(K.status_deltas(before, orders, lines, changes), 0)
        changes.unpersist()
        documents = hold(checked_orders(t, tasks)[0])
        held.append(documents)
        placed = M.place_orders(documents, parsed_col="__d")
        kind = lines.schema["product_id"].dataType
        headers = placed["orders"].hint("shuffle_hash") if tasks else placed["orders"]
        kept.add(K.placed_deltas(headers, placed["order_items"].withColumn("product_id", F.col("product_id").cast(kind)),
                                 doc_id="doc_id"), 1)
        documents.unpersist()
        asked = orders.where(F.col("created_at") < F.lit("1997-01-01").cast("date")).select("id")
        gone = M.cascade_delete({"shop_orders": orders, "order_items": lines}, "shop_orders", asked, _ORDER_FKS)
        refused = gone["__rejected"].select(F.col("root").alias("id"))
        kept.add(K.deleted_deltas(orders, lines, asked.join(refused, "id", "left_anti")), 2)
    finally:
        for df in held:
            df.unpersist()
    return t, kept.read()


@register("kept_sales")
def q_kept_sales(spark, sf_dir):
    return _kept_sales(spark, sf_dir)[1]


@register("kept_seller_scorecard")
def q_kept_seller_scorecard(spark, sf_dir):
    """A18 from the kept sums: no order line is read."""
    t, sales = _kept_sales(spark, sf_dir)
    return A.seller_scorecard(t["sellers"], t["users"], t["products"], t["order_items"], t["shop_orders"],
                              with_distinct_orders=False, sales=sales)


@register("kept_seller_statistics")
def q_kept_seller_statistics(spark, sf_dir):
    t, sales = _kept_sales(spark, sf_dir)
    return A.seller_statistics(t["sellers"], t["products"], t["order_items"], t["shop_orders"], t["comments"], sales=sales)


@register("kept_best_sellers")
def q_kept_best_sellers(spark, sf_dir):
    """A15 from the kept sums, after many orders were cancelled."""
    t, sales = _kept_sales(spark, sf_dir)
    return A.best_sellers(t["products"], t["order_items"], t["shop_orders"], k=50, sales=sales)


# ---------------------------------------------------------------- F5
def _product_index(spark, sf_dir):
    products = tables(spark, sf_dir)["products"]
    index = GramIndex(spark, _folder(spark, "grams"), "id", ["name", "description"], buckets=16)
    index.add(products)
    return index, products


@register("product_search")
def q_product_search(spark, sf_dir):
    """F5 for one needle, as a user types it, over all products."""
    index, products = _product_index(spark, sf_dir)
    return index.search(products, "D Gea")


@register("category_mentions")
def q_category_mentions(spark, sf_dir):
    """F5 for a table of needles: which products name which category in their texts."""
    index, products = _product_index(spark, sf_dir)
    needles = tables(spark, sf_dir)["categories"].select(F.col("en_name").alias("needle"))
    return index.search_many(products, needles).select("needle", "id")


# ---------------------------------------------------------------- F2-F4 / S1
@register("clustered_products")
def q_clustered_products(spark, sf_dir):
    """Range filters over products landed clustered by price, status and date, read by a typed scan."""
    root = _folder(spark, "clustered")
    save_clustered(tables(spark, sf_dir)["products"], f"{root}/products", ["price", "created_at", "status"], files=16)
    rows = load_table(spark, root, "products")
    return where_all(rows, [between_if("price", 91000, 96000), eq_if("status", "active"),
                            between_if("created_at", F.lit("2022-06-01").cast("date"), None)])
