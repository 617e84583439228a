"""SQL twins of the kept structures: everything is computed from scratch over the changed tables."""

from __future__ import annotations

from .oracle import W, sql
from .oracle_changes import _DOCS, _ST
from .oracle_listings import _RATING

# Lines of the orders that are left after the status changes and deletions, and of the placed orders.
_LINES = """states AS (SELECT o.id, o.created_at, COALESCE(l.status, o.status) AS status
  FROM shop_orders o LEFT JOIN last l ON o.id = l.order_id),
lines AS (
  SELECT oi.product_id, oi.quantity, oi.price_at_time, s.status FROM order_items oi JOIN states s ON s.id = oi.order_id
  WHERE NOT s.created_at < DATE '1997-01-01'
  UNION ALL
  SELECT l_partkey, CAST(l_quantity AS INT), CAST(l_extendedprice AS DECIMAL(12,2)), 'pending' FROM lineitem
  WHERE l_orderkey IN (SELECT doc_id FROM valid)),
sums AS (
  SELECT product_id, COUNT(*) AS n_items, CAST(SUM(quantity) AS BIGINT) AS units,
    CAST(SUM(quantity * price_at_time) AS DECIMAL(38,2)) AS revenue,
    COUNT(*) FILTER (status = 'cancelled') AS cancelled_items,
    CAST(COALESCE(SUM(quantity) FILTER (status = 'cancelled'), 0) AS BIGINT) AS cancelled_units
  FROM lines GROUP BY product_id)"""
_T = "shop_orders order_items products sellers order_status_changes users comments"
_SHOPS = """shops AS (SELECT p.seller_id AS shop, COUNT(*) AS n, SUM(s.n_items) AS items, SUM(s.revenue) AS income
  FROM products p LEFT JOIN sums s ON s.product_id = p.id GROUP BY p.seller_id)"""


def _kept(*extra: str) -> str:
    return W(_T, *_ST, *_DOCS, _LINES, *extra)


sql("kept_sales", _kept() + "SELECT * FROM sums")
sql("kept_seller_scorecard", _kept(_SHOPS) + """
SELECT s.id, s.shop_name, s.status, s.rating, s.created_at, u.id AS user_id, u.first_name, u.last_name, u.email,
  u.phone_number, COALESCE(x.n, 0) AS total_products, CAST(COALESCE(x.items, 0) AS BIGINT) AS total_orders,
  CAST(COALESCE(x.income, 0) AS DECIMAL(38,2)) AS total_revenue
FROM sellers s JOIN users u ON u.id = s.user_id LEFT JOIN shops x ON x.shop = s.id""")
sql("kept_seller_statistics", _kept(_SHOPS, f"""rated AS (
  SELECT p.seller_id AS shop, {_RATING} AS average_rating FROM products p JOIN comments AS c ON c.parent_id = p.id
  WHERE c.parent_type = 'product' AND c.status = 'approved' GROUP BY p.seller_id)""") + """
SELECT s.id AS seller_id, CAST(COALESCE(x.items, 0) AS BIGINT) AS total_orders,
  CAST(x.income AS DECIMAL(38,2)) AS total_revenue, r.average_rating
FROM sellers s LEFT JOIN shops x ON x.shop = s.id LEFT JOIN rated r ON r.shop = s.id""")
sql("kept_best_sellers", _kept() + """
SELECT p.id, p.name, p.price, p.seller_id, CAST(SUM(l.quantity) AS BIGINT) AS units_sold
FROM lines l JOIN products p ON p.id = l.product_id WHERE l.status <> 'cancelled'
GROUP BY p.id, p.name, p.price, p.seller_id ORDER BY units_sold DESC, p.id LIMIT 50""")

sql("product_search", W("products") + """
SELECT * FROM products WHERE lower(name) LIKE '%d gea%' OR lower(description) LIKE '%d gea%'""")
sql("category_mentions", W("products categories") + """
SELECT c.en_name AS needle, p.id FROM categories c JOIN products p
  ON contains(lower(p.name), lower(c.en_name)) OR contains(lower(p.description), lower(c.en_name))""")
sql("clustered_products", W("products") + """
SELECT * FROM products WHERE price BETWEEN 91000 AND 96000 AND status = 'active' AND created_at >= DATE '2022-06-01'""")
