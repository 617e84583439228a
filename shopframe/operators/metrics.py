"""Aggregations.

Correlated per-row subselects of the source model become one
pre-aggregation joined back by key. Line items are always reduced to one
row per product *before* they meet the product table, so the big side of
every join here is already aggregated (map-side partial aggregation, so a
hot product or seller is combined inside each task before the shuffle).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import key_join, row_counts

OUT_MONEY = "decimal(38,2)"


def _lit0(type_: str = "bigint") -> Column:
    return F.lit(0).cast(type_)


def count_by(df: DataFrame, key: str, as_: str) -> DataFrame:
    """(key, n) grouped count; the caller left-joins and defaults to 0 (A3)."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias(as_))


def attach_counts(parent: DataFrame, counts: DataFrame, pkey: str, cols: list[str]) -> DataFrame:
    out = parent.join(counts, parent[pkey] == counts["__k"], "left").drop("__k")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), _lit0()))
    return out


def items_in_orders(order_items: DataFrame, orders: DataFrame, statuses_excluded: list[str] | None = None,
                    counts: tuple[int, int] | None = None) -> DataFrame:
    """Order lines whose order exists (and optionally is not in some statuses).

    A semi join on the order key: only the order ids are read from the
    orders table, and line columns are never duplicated. ``counts`` are the rows
    of both tables, where they are known; they bound what one task joins.
    """
    o = orders
    if statuses_excluded:
        o = o.where(~F.col("status").isin(statuses_excluded))
    keys = o.select(F.col("id").alias("__oid"))
    n_lines, n_orders = counts or row_counts([order_items, orders])
    return key_join(order_items, keys, "order_id", "__oid", "left_semi", n_lines, n_orders)


def line_value(qty: str = "quantity", price: str = "price_at_time") -> Column:
    return F.col(qty).cast("bigint") * F.col(price)


def per_product_sales(items: DataFrame) -> DataFrame:
    """(product_id, n_items, units, revenue) — the one pass over order lines."""
    return (items.groupBy("product_id")
                 .agg(F.count(F.lit(1)).alias("n_items"),
                      F.sum(F.col("quantity").cast("bigint")).alias("units"),
                      F.sum(line_value()).alias("revenue")))


def seller_scorecard(sellers: DataFrame, users: DataFrame, products: DataFrame,
                     order_items: DataFrame, orders: DataFrame, status: str | None = None,
                     with_distinct_orders: bool = True, seller_page: tuple[DataFrame, int] | None = None,
                     trusted_fk: bool = False, sales: DataFrame | None = None) -> DataFrame:
    """Every seller with owner columns, product count, order-line count and revenue.

    ``total_orders`` keeps the source meaning (number of order *lines*);
    ``distinct_orders`` counts orders. Revenue is ``sum(quantity * price_at_time)``
    with 0 when the seller sold nothing.

    Plan: order lines are reduced to one row per product (partial
    aggregation), left-joined to the products, and one aggregate per seller
    yields product count, line count and revenue together. With
    ``seller_page`` (the rows of a page, which ``sellers`` is then, and its
    size) only those sellers' products, and only their order lines, are touched. ``trusted_fk`` skips
    the check that a line's order exists (proven by ``audit.orphans``). ``sales`` are kept sums per product
    (``rollups.KeptSales``): no order line is read then, unless distinct orders are asked for.
    """
    from .paging import of_page
    s = sellers if status is None else sellers.where(F.col("status") == status)
    prod = products.select(F.col("id").alias("__pid"), "seller_id").where(F.col("seller_id").isNotNull())
    lines = order_items
    if seller_page is not None:
        prod = of_page(prod, "seller_id", *seller_page)
        lines = order_items.join(prod.select(F.col("__pid").alias("__lp")),
                                 order_items["product_id"] == F.col("__lp"), "left_semi")
    # a page's lines are few; all lines are dealt by their number
    counted = [order_items, orders, products] if seller_page is None and (sales is None or with_distinct_orders) else []
    n_lines, n_orders, n_products = row_counts(counted) if counted else (0, 0, 0)
    items = lines if trusted_fk else items_in_orders(lines, orders, counts=(n_lines, n_orders))
    sales = per_product_sales(items) if sales is None else sales
    by_seller = (prod.join(sales, prod["__pid"] == sales["product_id"], "left")
                     .groupBy(F.col("seller_id").alias("__k"))
                     .agg(F.count(F.lit(1)).alias("total_products"),
                          F.sum("n_items").alias("total_orders"),
                          F.sum("revenue").alias("total_revenue")))
    u = users.select(F.col("id").alias("user_id"), "first_name", "last_name", "email", "phone_number")
    out = (s.select("id", "shop_name", "status", "rating", "created_at", F.col("user_id").alias("__uid"))
            .join(u, F.col("__uid") == u["user_id"], "inner").drop("__uid"))
    out = attach_counts(out, by_seller, "id", ["total_products", "total_orders"])
    out = out.withColumn("total_revenue", F.coalesce(F.col("total_revenue"), F.lit(0)).cast(OUT_MONEY))
    if with_distinct_orders:
        # the orders come last: rows that were dealt by their order need no shuffle to be made distinct
        sold = key_join(lines.select("order_id", "product_id"), prod, "product_id", "__pid", "inner", n_lines, n_products)
        pairs = sold.select("seller_id", "order_id")
        pairs = pairs if trusted_fk else items_in_orders(pairs, orders, counts=(n_lines, n_orders))
        by_orders = count_by(pairs.distinct(), "seller_id", "distinct_orders")
        out = attach_counts(out, by_orders, "id", ["distinct_orders"])
    return out


def seller_statistics(sellers: DataFrame, products: DataFrame, order_items: DataFrame,
                      orders: DataFrame, comments: DataFrame, sales: DataFrame | None = None) -> DataFrame:
    """Per seller: order-line count, revenue (null when none), average approved
    rating of the seller's products (null when none) (A5, D2). ``sales`` are kept sums
    per product (``rollups.KeptSales``), read in place of the order lines."""
    sales = per_product_sales(items_in_orders(order_items, orders)) if sales is None else sales
    prod = products.select(F.col("id").alias("__pid"), "seller_id")
    by_seller = (sales.join(prod, sales["product_id"] == prod["__pid"], "inner")
                      .groupBy(F.col("seller_id").alias("__k"))
                      .agg(F.sum("n_items").alias("total_orders"), F.sum("revenue").alias("total_revenue")))
    rated = approved_rating_sums(comments.where(F.col("parent_type") == "product"))
    rated = (rated.join(prod, rated["parent_id"] == prod["__pid"], "inner")
                  .groupBy(F.col("seller_id").alias("__r"))
                  .agg(F.sum("rating_sum").alias("rs"), F.sum("rating_count").alias("rc")))
    out = sellers.select(F.col("id").alias("seller_id"))
    out = out.join(by_seller, out["seller_id"] == by_seller["__k"], "left").drop("__k")
    out = out.join(rated, out["seller_id"] == rated["__r"], "left").drop("__r")
    return out.select(
        "seller_id",
        F.coalesce(F.col("total_orders"), _lit0()).alias("total_orders"),
        F.col("total_revenue").cast(OUT_MONEY).alias("total_revenue"),
        rating_average(F.col("rs"), F.col("rc")).alias("average_rating"))


# ---------------------------------------------------------------- A6 / M16
def rating_average(total: Column, n: Column) -> Column:
    """``sum/count`` rounded half-up to 2 places, exactly, as decimal(3,2).

    Integer arithmetic: round(100*s/n) = (200*s + n) div (2*n) for s, n > 0;
    no intermediate decimal or double rounding. Null when n is 0 or null.
    """
    num = F.lit(200) * total.cast("bigint") + n.cast("bigint")
    den = F.lit(2) * n.cast("bigint")
    # (num - num mod den) is an exact multiple of den, so the quotient is exact.
    hundredths = ((num - F.pmod(num, den)) / den).cast("bigint")
    return F.when(n > 0, (hundredths.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(3,2)"))


def approved_rating_sums(comments: DataFrame) -> DataFrame:
    """(parent_type, parent_id, rating_sum, rating_count) over approved comments."""
    return (comments.where(F.col("status") == "approved")
                    .groupBy("parent_type", "parent_id")
                    .agg(F.sum(F.col("rating").cast("bigint")).alias("rating_sum"),
                         F.count(F.lit(1)).alias("rating_count")))


def ratings(comments: DataFrame) -> DataFrame:
    """Approved-rating average per (parent_type, parent_id)."""
    return (approved_rating_sums(comments)
            .select("parent_type", "parent_id", F.col("rating_count").alias("n_ratings"),
                    rating_average(F.col("rating_sum"), F.col("rating_count")).alias("average_rating")))


def write_back_ratings(parents: DataFrame, comments: DataFrame, parent_type: str,
                       as_of=None) -> DataFrame:
    """Parents with ``average_rating`` recomputed from approved comments; 0.00
    when none (M16). Recomputing from source means a deleted or moved comment
    never leaves a stale value. ``as_of`` also touches ``updated_at`` of rows
    whose value changed (M15)."""
    r = ratings(comments.where(F.col("parent_type") == parent_type)).select(
        F.col("parent_id").alias("__k"), F.col("average_rating").alias("__avg"))
    out = parents.join(r, parents["id"] == r["__k"], "left")
    new = F.coalesce(F.col("__avg"), F.lit(Decimal("0.00")).cast("decimal(3,2)"))
    if as_of is not None and "updated_at" in parents.columns and "average_rating" in parents.columns:
        changed = ~F.col("average_rating").eqNullSafe(new)
        out = out.withColumn("updated_at", F.when(changed, F.lit(as_of).cast(parents.schema["updated_at"].dataType))
                             .otherwise(F.col("updated_at")))
    return out.withColumn("average_rating", new).drop("__k", "__avg")


# ---------------------------------------------------------------- A11 / A16
def single_category_products(bridge: DataFrame) -> DataFrame:
    """(category_id, product_id) for products whose *only* category it is."""
    per = (bridge.groupBy("product_id")
                 .agg(F.count(F.lit(1)).alias("__n"), F.min("category_id").alias("category_id")))
    return per.where(F.col("__n") == 1).select("category_id", "product_id")


# ---------------------------------------------------------------- A12 / A13 / A14 / A15
def order_totals(order_items: DataFrame) -> DataFrame:
    """Header total from lines: sum(quantity * price) per order."""
    return (order_items.groupBy("order_id")
                       .agg(F.count(F.lit(1)).alias("n_lines"),
                            F.sum(line_value()).cast(OUT_MONEY).alias("total_amount")))


def best_sellers(products: DataFrame, order_items: DataFrame, orders: DataFrame, k: int = 10,
                 sales: DataFrame | None = None) -> DataFrame:
    """Top ``k`` products by units sold in non-cancelled orders, ties by id (A15). ``sales`` are kept sums per product
    (``rollups.KeptSales``), read in place of the order lines."""
    if sales is None:
        items = items_in_orders(order_items, orders, statuses_excluded=["cancelled"])
        units = items.groupBy("product_id").agg(F.sum(F.col("quantity").cast("bigint")).alias("units_sold"))
    else:
        units = sales.where("n_items > cancelled_items").select(
            "product_id", (F.col("units") - F.col("cancelled_units")).alias("units_sold"))
    p = products.select("id", "name", "price", "seller_id")
    ranked = p.join(units, p["id"] == units["product_id"], "inner").drop("product_id")
    return ranked.orderBy(F.col("units_sold").desc(), F.col("id").asc()).limit(int(k))
