"""DuckDB SQL twins of the registered queries.

Written apart from the DataFrame code over the same derived tables (as
CTEs): children and measures are grouped by their key in CTEs of their own
and joined to the listed rows.
"""

from __future__ import annotations

from ..sources.fixtures import DERIVED_SQL, _PLACEHOLDER, dependency_order

ORACLE: dict[str, str] = {}


def W(names: str, *extra: str) -> str:
    """WITH clause: derived tables named in ``names`` (and the derived tables
    they read) plus extra ``x AS (...)`` CTEs."""
    parts = []
    for n in dependency_order(names.split()):
        body = _PLACEHOLDER.sub(lambda m: m.group(1), DERIVED_SQL[n]).strip()
        parts.append(f"{n} AS ({body})")
    parts.extend(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def sql(name: str, text: str):
    ORACLE[name] = text


# ---------------------------------------------------------------- Q15 / A18
# One row per product with its lines of existing orders, then one row per shop.
SALES = """sold AS (
  SELECT product_id, order_id, quantity * price_at_time AS income FROM order_items
  WHERE order_id IN (SELECT id FROM shop_orders)),
product_sales AS (SELECT product_id, count(*) AS line_count, sum(income) AS income FROM sold GROUP BY product_id),
shop_sales AS (
  SELECT seller_id AS shop, count(*) AS product_count, sum(line_count) AS line_count, sum(income) AS income
  FROM products LEFT JOIN product_sales ON product_sales.product_id = products.id GROUP BY seller_id),
shop_orders_seen AS (
  SELECT seller_id AS shop, count(DISTINCT order_id) AS order_count
  FROM sold INNER JOIN products ON products.id = sold.product_id GROUP BY seller_id)"""
_BOARD = SALES + """,
board AS (
  SELECT shops.id, shops.shop_name, shops.status, shops.rating, shops.created_at, owner.id AS user_id,
         owner.first_name, owner.last_name, owner.email, owner.phone_number,
         coalesce(shop_sales.product_count, 0) AS total_products,
         CAST(coalesce(shop_sales.line_count, 0) AS BIGINT) AS total_orders, {distinct}
         CAST(coalesce(shop_sales.income, 0) AS DECIMAL(38,2)) AS total_revenue
  FROM (SELECT * FROM sellers {where}) AS shops
  INNER JOIN users AS owner ON owner.id = shops.user_id
  LEFT JOIN shop_sales ON shop_sales.shop = shops.id
  LEFT JOIN shop_orders_seen ON shop_orders_seen.shop = shops.id)"""
_BOARD_TABLES = "sellers users products order_items shop_orders"
_DISTINCT = "coalesce(shop_orders_seen.order_count, 0) AS distinct_orders,"

sql("seller_leaderboard", W(_BOARD_TABLES, _BOARD.format(where="", distinct="")) +
    "SELECT * FROM board ORDER BY created_at DESC NULLS FIRST, id LIMIT 10 OFFSET 0")
sql("seller_leaderboard_by_rating", W(_BOARD_TABLES, _BOARD.format(where="WHERE status = 'active'", distinct="")) +
    "SELECT * FROM board ORDER BY rating DESC NULLS FIRST, id LIMIT 20 OFFSET 5")
sql("seller_scorecard", W(_BOARD_TABLES, _BOARD.format(where="", distinct=_DISTINCT)) + "SELECT * FROM board")
sql("seller_leaderboard_count", W("sellers users") + """
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(CEIL(COUNT(*) / 10.0) AS BIGINT) AS total_pages,
       CAST(1 AS BIGINT) AS current_page, CAST(10 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS "offset"
FROM sellers WHERE status = 'active' AND user_id IN (SELECT id FROM users)""")

# The remaining twins live in topic modules that import ``sql`` and ``W`` from here.
from . import oracle_changes, oracle_kept, oracle_listings  # noqa: E402,F401
