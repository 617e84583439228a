"""SQL twins for listing, lookup and metric queries."""

from __future__ import annotations

from .oracle import SALES, W, sql

# One row per product (or other parent) with its children as text, in CTEs that are joined by key.
_CHILD_CTES = ("""category_text AS (
  SELECT link.product_id AS parent, string_agg(concat_ws(':', categories.id, categories.fa_name, categories.en_name), ','
         ORDER BY categories.id) AS categories
  FROM product_categories AS link INNER JOIN categories ON categories.id = link.category_id GROUP BY link.product_id)""",
"""image_text AS (
  SELECT product_id AS parent, string_agg(concat_ws(':', id, image_url, is_main), ',' ORDER BY id) AS images
  FROM product_images GROUP BY product_id)""",
"""feature_text AS (
  SELECT product_id AS parent, string_agg(name || '=' || value, ';' ORDER BY name, value) AS feature_pairs
  FROM product_features GROUP BY product_id)""")
_CARD_COLS = """listed.id, listed.name, listed.price, listed.description, listed.stock, listed.status, listed.created_at,
  shop.shop_name AS seller_name, shop.rating AS seller_rating, category_text.categories, image_text.images,
  feature_text.feature_pairs"""
_CARD_JOINS = """LEFT JOIN sellers AS shop ON shop.id = listed.seller_id
LEFT JOIN category_text ON category_text.parent = listed.id
LEFT JOIN image_text ON image_text.parent = listed.id
LEFT JOIN feature_text ON feature_text.parent = listed.id"""
_CAT_T = "products sellers categories product_categories product_images product_features"


def _cards(condition: str, order: str, limit: int, offset: int = 0) -> str:
    """A page of product cards: the page first, then the joins."""
    listed = (f"listed AS (SELECT * FROM products WHERE {condition} ORDER BY {order}, id "
              f"LIMIT {limit} OFFSET {offset})")
    return W(_CAT_T, *_CHILD_CTES, listed) + f"SELECT {_CARD_COLS} FROM listed {_CARD_JOINS}"


_ACTIVE = "status = 'active'"
_NEWEST = "created_at DESC NULLS FIRST"
sql("catalogue_page", _cards(_ACTIVE, _NEWEST, 10))

_CAT_WHERE = f"""{_ACTIVE} AND price BETWEEN 90000 AND 98000 AND (name ILIKE '%R%' OR description ILIKE '%R%')
  AND id IN (SELECT product_id FROM product_categories WHERE category_id = 'Brand#4')"""

sql("catalogue_page_filtered", _cards(_CAT_WHERE, "price ASC NULLS LAST", 10, 5))


def _page_info(where_sql: str, limit: int, offset: int, count: str = "COUNT(*)") -> str:
    return f"""SELECT CAST(n AS BIGINT) AS total, CAST(CEIL(n / {limit}.0) AS BIGINT) AS total_pages,
  CAST({offset // limit + 1} AS BIGINT) AS current_page, CAST({limit} AS BIGINT) AS "limit",
  CAST({offset} AS BIGINT) AS "offset" FROM (SELECT {count} AS n {where_sql}) x"""


sql("catalogue_count", W(_CAT_T) + _page_info(f"FROM products WHERE {_CAT_WHERE}", 10, 5, "COUNT(DISTINCT id)"))
sql("page_info", W(_CAT_T) + _page_info(f"FROM products WHERE {_ACTIVE}", 10, 20, "COUNT(DISTINCT id)"))
sql("new_arrivals", _cards(_ACTIVE, _NEWEST, 10))

sql("product_lookup", W(_CAT_T + " comments", *_CHILD_CTES,
                        "wanted AS (SELECT DISTINCT parent_id FROM comments WHERE parent_type = 'product')") + f"""
SELECT wanted.parent_id AS id, listed.id IS NOT NULL AS found, {_CARD_COLS.removeprefix('listed.id, ')}
FROM wanted LEFT JOIN products AS listed ON listed.id = wanted.parent_id {_CARD_JOINS}""")

_IN_CAT = f"""{_ACTIVE} AND id IN (SELECT product_id FROM product_categories WHERE category_id IN (
  SELECT id FROM categories WHERE 'LARGE' IN (CAST(id AS VARCHAR), en_name)))"""

sql("category_products", _cards(_IN_CAT, "price DESC NULLS FIRST", 10, 10))
sql("category_products_count", W(_CAT_T) + _page_info(f"FROM products WHERE {_IN_CAT}", 10, 10))

sql("seller_profiles", W("sellers users") + """
SELECT sellers.*, owner.first_name, owner.last_name FROM users AS owner INNER JOIN sellers ON sellers.user_id = owner.id""")

sql("category_lookup", W("categories product_features") + """
SELECT k.id, c.en_name, c.fa_name, c.id IS NOT NULL AS found
FROM (SELECT DISTINCT value AS id FROM product_features) k LEFT JOIN categories c ON c.id = k.id""")

# ---------------------------------------------------------------- Q10
_PREVIEW = ("CASE WHEN {c} IS NULL THEN NULL ELSE substr({c}, 1, 200) || "
            "CASE WHEN length({c}) > 200 THEN '...' ELSE '' END END")
_SP_T = "products sellers categories product_categories product_images order_items"


def _seller_products(condition: str, order: str, lo: int, hi: int) -> str:
    numbered = (f"listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY {order}, id) "
                f"AS rank_in_key FROM products WHERE seller_id IS NOT NULL AND {condition}) AS every "
                f"WHERE rank_in_key BETWEEN {lo + 1} AND {hi})")
    lines = "line_counts AS (SELECT product_id AS parent, count(*) AS n FROM order_items GROUP BY product_id)"
    return W(_SP_T, *_CHILD_CTES[:2], lines, numbered) + f"""
SELECT listed.id, listed.name AS title, {_PREVIEW.format(c='listed.description')} AS description, listed.price,
  listed.stock, listed.status, listed.created_at, listed.seller_id, listed.rank_in_key,
  shop.shop_name AS seller_name, shop.rating AS seller_rating, coalesce(category_text.categories, '') AS categories,
  coalesce(image_text.images, '') AS images, coalesce(line_counts.n, 0) AS total_orders
FROM listed LEFT JOIN sellers AS shop ON shop.id = listed.seller_id
LEFT JOIN category_text ON category_text.parent = listed.id
LEFT JOIN image_text ON image_text.parent = listed.id
LEFT JOIN line_counts ON line_counts.parent = listed.id"""


_STATUS_RANK = "CASE {c} WHEN 'active' THEN 1 WHEN 'inactive' THEN 2 WHEN 'out_of_stock' THEN 3 END"
sql("seller_products", _seller_products("TRUE", "price DESC NULLS FIRST", 0, 5))
_SP_WHERE = (f"{_ACTIVE} AND price BETWEEN 92000 AND 97000.5 "
             "AND (name ILIKE '%ring%' OR description ILIKE '%ring%')")
sql("seller_products_filtered", _seller_products(_SP_WHERE, _STATUS_RANK.format(c="status") + " ASC NULLS LAST",
                                                 1, 11))


def _seller_totals(condition: str, limit: int, offset: int) -> str:
    return W("products product_categories sellers", f"""matches AS (
  SELECT seller_id AS shop, count(*) AS n FROM products WHERE {condition} GROUP BY seller_id)""") + f"""
SELECT sellers.id AS seller_id, coalesce(n, 0) AS total, CAST(ceil(coalesce(n, 0) / {limit}.0) AS BIGINT) AS total_pages,
  CAST({limit} AS BIGINT) AS "limit", CAST({offset} AS BIGINT) AS "offset"
FROM sellers LEFT JOIN matches ON matches.shop = sellers.id"""


sql("seller_products_count", _seller_totals(
    f"{_ACTIVE} AND (name ILIKE '%ring%' OR description ILIKE '%ring%')", 10, 1))
sql("seller_products_count_filtered", _seller_totals(f"""{_ACTIVE} AND price BETWEEN 92000 AND 97000.5
  AND id IN (SELECT product_id FROM product_categories WHERE category_id = 'Brand#4')""", 5, 0))

# ---------------------------------------------------------------- Q12 / Q13 / Q17
_SO_T = "shop_orders users addresses order_items products"
_SO_PAIRS = """pairs AS (SELECT {distinct} products.seller_id, order_items.order_id
  FROM products INNER JOIN order_items ON order_items.product_id = products.id WHERE products.seller_id IS NOT NULL)"""
_SO = """SELECT pairs.seller_id, placed.*, buyer.first_name, buyer.last_name, target.address, target.city,
  target.province, target.postal_code
FROM pairs INNER JOIN shop_orders AS placed ON placed.id = pairs.order_id
INNER JOIN users AS buyer ON buyer.id = placed.user_id
INNER JOIN addresses AS target ON target.id = placed.address_id"""
sql("seller_orders", W(_SO_T, _SO_PAIRS.format(distinct="DISTINCT")) + _SO)
sql("seller_orders_raw", W(_SO_T, _SO_PAIRS.format(distinct="")) + _SO)

_RATING = ("CASE WHEN COUNT(*) > 0 THEN CAST(CAST((200 * SUM(c.rating) + COUNT(*)) // (2 * COUNT(*)) "
           "AS DECIMAL(20,0)) * 0.01 AS DECIMAL(3,2)) END")
sql("seller_statistics", W("sellers products order_items shop_orders comments", SALES,
                           f"""shop_ratings AS (
  SELECT products.seller_id AS shop, {_RATING} AS average_rating
  FROM products INNER JOIN comments AS c ON c.parent_id = products.id
  WHERE c.parent_type = 'product' AND c.status = 'approved' GROUP BY products.seller_id)""") + """
SELECT sellers.id AS seller_id, CAST(coalesce(shop_sales.line_count, 0) AS BIGINT) AS total_orders,
  CAST(shop_sales.income AS DECIMAL(38,2)) AS total_revenue, shop_ratings.average_rating
FROM sellers LEFT JOIN shop_sales ON shop_sales.shop = sellers.id
LEFT JOIN shop_ratings ON shop_ratings.shop = sellers.id""")

sql("my_orders", W("shop_orders addresses") + """
SELECT placed.*, target.address, target.city, target.province, target.postal_code
FROM addresses AS target INNER JOIN shop_orders AS placed ON placed.address_id = target.id""")

# ---------------------------------------------------------------- Q19 / Q22
_CART_T = "carts cart_items products sellers product_images"
_CART_CTES = ("""main_image AS (
  SELECT product_id, arg_min(image_url, id) AS main_image_url FROM product_images WHERE is_main GROUP BY product_id)""",
"""cart_rows AS (
  SELECT held.cart_id, held.product_id, held.quantity, held.price AS price_per_item, held.created_at,
    article.name AS product_name, article.description, article.stock AS available_stock,
    article.status AS product_status, shop.shop_name AS seller_name, main_image.main_image_url,
    held.quantity * held.price AS total_price
  FROM cart_items AS held INNER JOIN products AS article ON article.id = held.product_id
  INNER JOIN sellers AS shop ON shop.id = article.seller_id
  LEFT JOIN main_image ON main_image.product_id = article.id)""")
sql("cart_lines", W(_CART_T, *_CART_CTES) + "SELECT * FROM cart_rows")
sql("cart_summary", W(_CART_T, *_CART_CTES, """sums AS (
  SELECT cart_id, string_agg(DISTINCT seller_name, ',' ORDER BY seller_name) AS sellers, count(*) AS item_count,
    sum(quantity) AS total_items, sum(total_price) AS total_price FROM cart_rows GROUP BY cart_id)""") + """
SELECT carts.id AS cart_id, carts.user_id, coalesce(sums.sellers, '') AS sellers,
  coalesce(sums.item_count, 0) AS item_count, CAST(coalesce(sums.total_items, 0) AS BIGINT) AS total_items,
  CAST(coalesce(sums.total_price, 0) AS BIGINT) AS total_price
FROM carts LEFT JOIN sums ON sums.cart_id = carts.id""")
sql("cart_contains", W(_CART_T + " shop_orders order_items", _CART_CTES[0], """asked AS (
  SELECT DISTINCT shop_orders.user_id, order_items.product_id
  FROM order_items INNER JOIN shop_orders ON shop_orders.id = order_items.order_id)""",
                       """stocked AS (
  SELECT carts.user_id, held.cart_id, held.product_id, held.quantity, held.price AS cart_price,
    article.name AS product_name, article.price AS current_price, article.stock AS available_stock,
    main_image.main_image_url
  FROM carts INNER JOIN cart_items AS held ON held.cart_id = carts.id
  INNER JOIN products AS article ON article.id = held.product_id
  LEFT JOIN main_image ON main_image.product_id = article.id)""") + """
SELECT user_id, product_id, stocked.cart_id IS NOT NULL AS in_cart, stocked.* EXCLUDE (user_id, product_id)
FROM asked LEFT JOIN stocked USING (user_id, product_id)""")

# ---------------------------------------------------------------- Q26
_BLOG_T = "blogs users comments blog_tags"


def _blogs(condition: str = "TRUE", page: str = "") -> str:
    return W(_BLOG_T, f"listed AS (SELECT * FROM blogs WHERE {condition} {page})", """tag_text AS (
  SELECT blog_id, string_agg(name, ',' ORDER BY name) AS tags FROM blog_tags GROUP BY blog_id)""", """remarks AS (
  SELECT parent_id, count(*) AS n FROM comments WHERE parent_type = 'blog' GROUP BY parent_id)""") + f"""
SELECT listed.id, listed.title, {_PREVIEW.format(c='listed.content')} AS content, listed.category, listed.views,
  listed.created_at, writer.id AS author_id, writer.first_name AS author_first_name,
  writer.last_name AS author_last_name, coalesce(remarks.n, 0) AS comment_count, coalesce(tag_text.tags, '') AS tags
FROM listed LEFT JOIN users AS writer ON writer.id = listed.author_id
LEFT JOIN remarks ON remarks.parent_id = listed.id LEFT JOIN tag_text ON tag_text.blog_id = listed.id"""


sql("blog_listing", _blogs(page=f"ORDER BY {_NEWEST}, id LIMIT 10"))
sql("blog_listing_by_views", _blogs("category = 'en'", "ORDER BY views DESC NULLS FIRST, id LIMIT 10 OFFSET 10"))
sql("blog_listing_all", _blogs())

sql("blog_count", W("blogs") + _page_info("FROM blogs WHERE category = 'en'", 10, 10))
sql("blog_lookup", W("blogs comments", """asked AS (
  SELECT parent_id AS id FROM comments WHERE parent_type = 'blog'
  UNION SELECT parent_id * 2 FROM comments WHERE parent_type = 'blog')""") + """
SELECT asked.id, blogs.id IS NOT NULL AS found, title, category, views, author_id
FROM asked LEFT JOIN blogs ON blogs.id = asked.id""")
sql("blog_update", W("blogs blog_changes") + """
SELECT blogs.* REPLACE (coalesce(blog_changes.title, blogs.title) AS title,
  coalesce(blog_changes.content, blogs.content) AS content)
FROM blogs LEFT JOIN blog_changes ON blog_changes.id = blogs.id""")
sql("blog_update_rejected", W("blogs blog_changes") +
    "SELECT *, 'blog not found' AS reason FROM blog_changes WHERE id NOT IN (SELECT id FROM blogs)")
_GONE = "gone AS (SELECT id FROM blog_changes WHERE title IS NULL)"
sql("blog_delete", W("blogs blog_changes", _GONE) + "SELECT * FROM blogs WHERE id NOT IN (SELECT id FROM gone)")
sql("blog_delete_tags", W("blog_tags blog_changes", _GONE) +
    "SELECT * FROM blog_tags WHERE blog_id NOT IN (SELECT id FROM gone)")
sql("blog_delete_unknown", W("blogs blog_changes", _GONE) + "SELECT id FROM gone WHERE id NOT IN (SELECT id FROM blogs)")

# ---------------------------------------------------------------- Q28 / Q29
_MOD_T = "comments users products blogs"
_MOD_JOINED = """remarks AS (
  SELECT comments.*, writer.id AS writer_id, writer.first_name, writer.last_name, writer.email
  FROM comments LEFT JOIN users AS writer ON writer.id = comments.user_id)"""
_MOD_ITEMS = """items AS (SELECT 'product' AS kind, id, name, NULL AS title FROM products
  UNION ALL SELECT 'blog', id, NULL, title FROM blogs)"""
_MOD_WHERE = ("parent_type = 'product' AND (content ILIKE '%PURCH%' OR first_name ILIKE '%PURCH%' "
              "OR last_name ILIKE '%PURCH%' OR email ILIKE '%PURCH%')")
_CSTATUS = "CASE status WHEN 'pending' THEN 1 WHEN 'approved' THEN 2 WHEN 'rejected' THEN 3 END"


def _moderation(condition: str, page: str) -> str:
    return W(_MOD_T, _MOD_JOINED, _MOD_ITEMS, f"listed AS (SELECT * FROM remarks WHERE {condition} {page})") + """
SELECT listed.id, listed.content, listed.rating, listed.status, listed.parent_type, listed.parent_id,
  listed.created_at, listed.writer_id AS user_id, listed.first_name AS user_first_name,
  listed.last_name AS user_last_name, listed.email AS user_email, items.id AS parent_item_id,
  items.name AS parent_item_name, items.title AS parent_item_title
FROM listed LEFT JOIN items ON items.kind = listed.parent_type AND items.id = listed.parent_id"""


sql("moderation_list", _moderation("TRUE", f"ORDER BY {_NEWEST}, id LIMIT 10"))
sql("moderation_list_filtered", _moderation(_MOD_WHERE, f"ORDER BY {_CSTATUS} ASC NULLS LAST, id LIMIT 15 OFFSET 3"))
sql("moderation_count", W("comments users", _MOD_JOINED) + _page_info(f"FROM remarks WHERE {_MOD_WHERE}", 15, 3))


def _public(condition: str, lo: int, hi: int) -> str:
    numbered = (f"numbered AS (SELECT *, row_number() OVER (PARTITION BY parent_type, parent_id ORDER BY {_NEWEST}, id) "
                f"AS rank_in_key FROM comments WHERE {condition})")
    return W("comments users", numbered) + f"""
SELECT numbered.* EXCLUDE (user_id), writer.id AS user_id, writer.first_name, writer.last_name
FROM numbered LEFT JOIN users AS writer ON writer.id = numbered.user_id WHERE rank_in_key BETWEEN {lo + 1} AND {hi}"""


sql("public_comments", _public("status = 'approved'", 0, 10))
sql("public_comments_count", W("comments") + """
SELECT parent_type, parent_id, count(*) AS total, CAST(ceil(count(*) / 3.0) AS BIGINT) AS total_pages,
  CAST(3 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS "offset"
FROM comments WHERE status = 'approved' GROUP BY parent_type, parent_id""")
sql("public_comments_admin", _public("status = 'rejected'", 1, 4))

# ---------------------------------------------------------------- Q31 / Q33 / Q35
_SHOP_OF = """first_shop AS (
  SELECT user_id AS owner, unnest(arg_min({'id': id, 'shop_name': shop_name, 'status': status, 'rating': rating}, id))
  FROM sellers WHERE user_id IS NOT NULL GROUP BY user_id)"""
sql("user_with_seller", W("users sellers", _SHOP_OF) + """
SELECT users.id, first_name, last_name, email, phone_number, role, is_verified, created_at,
  first_shop.id AS seller_id, first_shop.shop_name AS seller_shop_name, first_shop.status AS seller_status,
  first_shop.rating AS seller_rating
FROM users LEFT JOIN first_shop ON first_shop.owner = users.id AND users.role = 'seller'""")
sql("addresses_ordered", W("addresses") + "SELECT * FROM addresses")

_U_T = "users sellers shop_orders"


def _users(condition: str, page: str) -> str:
    return W(_U_T, _SHOP_OF, f"listed AS (SELECT * FROM users WHERE {condition} {page})",
             "bought AS (SELECT user_id, count(*) AS n FROM shop_orders GROUP BY user_id)") + """
SELECT listed.id, listed.first_name, listed.last_name, listed.email, listed.phone_number, listed.role,
  listed.is_verified, listed.created_at, first_shop.id AS seller_info_id,
  first_shop.shop_name AS seller_info_shop_name, first_shop.status AS seller_info_status,
  first_shop.rating AS seller_info_rating, coalesce(bought.n, 0) AS total_orders
FROM listed LEFT JOIN first_shop ON first_shop.owner = listed.id LEFT JOIN bought ON bought.user_id = listed.id"""


_U_WHERE = ("is_verified AND (first_name ILIKE '%00001%' OR last_name ILIKE '%00001%' "
            "OR email ILIKE '%00001%' OR phone_number ILIKE '%00001%')")
_ROLE = "CASE role WHEN 'admin' THEN 1 WHEN 'seller' THEN 2 WHEN 'customer' THEN 3 END"
sql("user_listing", _users("TRUE", f"ORDER BY {_NEWEST}, id LIMIT 10"))
sql("user_listing_filtered", _users(_U_WHERE, "ORDER BY email ASC NULLS LAST, id LIMIT 10 OFFSET 2"))
sql("user_listing_by_role", _users("NOT is_verified", f"ORDER BY {_ROLE} DESC NULLS FIRST, id LIMIT 10"))
sql("user_count", W("users") + _page_info(f"FROM users WHERE {_U_WHERE}", 10, 2))

# ---------------------------------------------------------------- A6 / A11 / A14 / A15 / A16 / M9 / M16
sql("ratings", W("comments") + f"""
SELECT c.parent_type, c.parent_id, COUNT(*) AS n_ratings, {_RATING} AS average_rating
FROM comments c WHERE c.status = 'approved' GROUP BY c.parent_type, c.parent_id""")
sql("ratings_written_back", W("products blogs comments", f"""averages AS (
  SELECT c.parent_type, c.parent_id, {_RATING} AS average_rating FROM comments AS c WHERE c.status = 'approved'
  GROUP BY c.parent_type, c.parent_id)""", """rated AS (
  SELECT 'product' AS parent_type, id FROM products UNION ALL SELECT 'blog', id FROM blogs)""") + """
SELECT rated.parent_type, rated.id, coalesce(averages.average_rating, CAST(0 AS DECIMAL(3,2))) AS average_rating
FROM rated LEFT JOIN averages ON averages.parent_type = rated.parent_type AND averages.parent_id = rated.id""")

_ONLY = """only_cat AS (SELECT product_id, MIN(category_id) AS category_id FROM product_categories
  GROUP BY product_id HAVING COUNT(*) = 1)"""
sql("single_category_products", W("product_categories", _ONLY) + "SELECT category_id, product_id FROM only_cat")
_REFUSED = """refused AS (SELECT o.category_id, CAST(COUNT(*) AS BIGINT) AS n_blocking
  FROM only_cat o JOIN products p ON p.id = o.product_id
  WHERE o.category_id IN (SELECT id FROM categories) GROUP BY o.category_id)"""
_CD_T = "categories product_categories products"
sql("category_delete", W(_CD_T, _ONLY, _REFUSED) + "SELECT * FROM refused")
sql("category_delete_names", W(_CD_T, _ONLY) + """
SELECT only_cat.category_id, string_agg(products.name, ', ' ORDER BY products.name) AS blocking_products
FROM only_cat INNER JOIN products ON products.id = only_cat.product_id
INNER JOIN categories ON categories.id = only_cat.category_id AND starts_with(categories.en_name, 'S')
GROUP BY only_cat.category_id""")
sql("category_delete_blocking", W(_CD_T, _ONLY) + """
SELECT o.category_id, o.product_id, p.name FROM only_cat o JOIN products p ON p.id = o.product_id
WHERE o.category_id IN (SELECT id FROM categories)""")
sql("category_delete_remaining",W(_CD_T, _ONLY, _REFUSED) +
    "SELECT * FROM categories WHERE id IN (SELECT category_id FROM refused)")
sql("category_delete_bridge", W(_CD_T, _ONLY, _REFUSED) +
    "SELECT * FROM product_categories WHERE category_id IN (SELECT category_id FROM refused) "
    "OR category_id NOT IN (SELECT id FROM categories)")

sql("order_totals", W("order_items") + """
SELECT order_id, COUNT(*) AS n_lines, CAST(SUM(quantity * price_at_time) AS DECIMAL(38,2)) AS total_amount
FROM order_items GROUP BY order_id""")
sql("best_sellers", W("products order_items shop_orders") + """
SELECT p.id, p.name, p.price, p.seller_id, CAST(SUM(oi.quantity) AS BIGINT) AS units_sold
FROM order_items oi JOIN shop_orders o ON o.id = oi.order_id AND o.status <> 'cancelled'
JOIN products p ON oi.product_id = p.id
GROUP BY p.id, p.name, p.price, p.seller_id ORDER BY units_sold DESC, p.id LIMIT 10""")
