"""SQL twins for windows, change application and audits."""

from __future__ import annotations

from ..sources.fixtures import AS_OF
from .oracle import ORACLE, W, sql

TS = f"TIMESTAMP '{AS_OF}'"


def _key(ns: str, *cols: str) -> str:
    parts = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(('0x' || substr(md5('{ns}:' || {parts}), 1, 15)) AS BIGINT)"


def _last(col: str, filt: str | None = None, desc: bool = True) -> str:
    d = "DESC" if desc else ""
    f = f" FILTER (WHERE {filt})" if filt else ""
    return f"first({col} ORDER BY change_ts {d}, seq {d}){f}"


# ---------------------------------------------------------------- W1 / F9 / W2 / M18
sql("latest_code", W("email_verifications") + """
SELECT * EXCLUDE (rn) FROM (SELECT v.*, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) rn
FROM email_verifications v) WHERE rn = 1""")
sql("live_codes", W("email_verifications") + f"""
SELECT * FROM email_verifications WHERE expires_at > {TS} AND COALESCE(attempts, 0) < 5""")


def _trailing(window_us: int) -> str:
    return W("email_verifications") + f"""
SELECT v.*, n_in_window >= 5 AS blocks_next FROM (
  SELECT v.*, COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(created_at)
    RANGE BETWEEN {window_us - 1} PRECEDING AND CURRENT ROW) AS n_in_window FROM email_verifications v) v"""


sql("trailing_attempts", _trailing(86400 * 10**6))
sql("trailing_attempts_hour", _trailing(3600 * 10**6))
sql("trailing_attempts_spread", _trailing(86400 * 10**6))

_CAND = ("""cand AS (SELECT v.*, s.submitted_at AS sub_at, s.code AS scode FROM email_verifications v
  JOIN code_submissions s ON v.user_id = s.user_id AND v.verification_code = s.code
  WHERE v.expires_at > s.submitted_at AND v.created_at <= s.submitted_at AND COALESCE(v.attempts, 0) < 5)""",
         """per_sub AS (SELECT * EXCLUDE (rn) FROM (SELECT cand.*, ROW_NUMBER() OVER (PARTITION BY user_id, sub_at, scode
  ORDER BY created_at DESC, id DESC) rn FROM cand) WHERE rn = 1)""",
         """matched AS (SELECT * EXCLUDE (rn, sub_at, scode) FROM (SELECT per_sub.*, ROW_NUMBER() OVER (
  PARTITION BY user_id ORDER BY sub_at, scode) rn FROM per_sub) WHERE rn = 1)""")
_CT = "email_verifications code_submissions users"
sql("consume_codes", W(_CT, *_CAND) + "SELECT * FROM matched")
sql("consume_codes_remaining", W(_CT, *_CAND) +
    "SELECT * FROM email_verifications WHERE user_id NOT IN (SELECT user_id FROM matched)")
sql("consume_codes_users", W(_CT, *_CAND) +
    "SELECT id, CASE WHEN id IN (SELECT user_id FROM matched) THEN TRUE ELSE is_verified END AS is_verified FROM users")

# ---------------------------------------------------------------- M14 / M6
sql("token_purge", W("refresh_tokens") + f"""
SELECT * FROM refresh_tokens WHERE NOT (expires_at < {TS} OR COALESCE(is_revoked, FALSE))""")
_ROT = (f"live AS (SELECT * FROM refresh_tokens WHERE NOT COALESCE(is_revoked, FALSE) AND expires_at > {TS})",
        """w AS (SELECT * FROM (SELECT p.token, p.change_ts, p.seq, l.user_id, ROW_NUMBER() OVER (
  PARTITION BY l.user_id ORDER BY p.change_ts, p.seq) AS rn FROM presented_tokens p JOIN live l ON p.token = l.token)
  WHERE rn = 1)""",
        "per_user AS (SELECT user_id, token AS last FROM w)")
sql("token_rotation", W("refresh_tokens presented_tokens", *_ROT) + f"""
SELECT * FROM refresh_tokens WHERE user_id NOT IN (SELECT user_id FROM per_user)
UNION ALL
SELECT {_key('refresh_token', 'user_id', 'last')}, user_id,
  sha256('refresh:' || CAST(user_id AS VARCHAR) || ':' || last || ':{AS_OF}'),
  {TS} + INTERVAL 7 DAY, FALSE, {TS}
FROM per_user""")
sql("token_rotation_rejected", W("refresh_tokens presented_tokens", *_ROT) + """
SELECT p.token, p.change_ts, p.seq FROM presented_tokens p
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.token = p.token AND w.change_ts = p.change_ts AND w.seq = p.seq)""")

# ---------------------------------------------------------------- W5 / W3 / W4
_CHOSEN = ("""valid AS (SELECT r.* FROM address_requests r
  WHERE EXISTS (SELECT 1 FROM addresses a WHERE a.user_id = r.user_id AND a.id = r.id))""",
           f"chosen AS (SELECT user_id, {_last('id')} AS id FROM valid GROUP BY user_id)",
           """after AS (SELECT a.id, a.user_id, a.address, a.city, a.province, a.postal_code,
  CASE WHEN c.user_id IS NOT NULL THEN a.id = c.id ELSE a.is_default END AS is_default, a.created_at
  FROM addresses a LEFT JOIN chosen c ON a.user_id = c.user_id)""")
sql("default_address", W("addresses address_requests", *_CHOSEN) + "SELECT * FROM after")

sql("promote_main_image", W(
    "product_images deleted_images",
    "lost AS (SELECT DISTINCT product_id FROM product_images WHERE is_main AND id IN (SELECT id FROM deleted_images))",
    "rest AS (SELECT * FROM product_images WHERE id NOT IN (SELECT id FROM deleted_images))",
    """st AS (SELECT product_id, MAX(CAST(is_main AS INT)) AS has, MIN(id) AS first_id FROM rest
       WHERE product_id IN (SELECT product_id FROM lost) GROUP BY product_id)""") + """
SELECT r.id, r.product_id, r.image_url,
  CASE WHEN r.id IN (SELECT first_id FROM st WHERE has = 0) THEN TRUE ELSE r.is_main END AS is_main
FROM rest r""")

sql("first_image_flag", W("product_images image_uploads") + """
SELECT product_id, image_url, change_ts, seq,
  (rn = 1 AND NOT EXISTS (SELECT 1 FROM product_images pi WHERE pi.product_id = r.product_id)) AS is_main
FROM (SELECT u.*, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY change_ts, seq) rn FROM image_uploads u) r""")

# ---------------------------------------------------------------- M2 / M3 / F12 / M22
sql("patch_coalesce", W("users user_changes", f"""pk AS (SELECT id, {_last('first_name', 'first_name IS NOT NULL')} AS nf,
  {_last('last_name', 'last_name IS NOT NULL')} AS nl FROM user_changes GROUP BY id)""") + """
SELECT u.id, COALESCE(pk.nf, u.first_name) AS first_name, COALESCE(pk.nl, u.last_name) AS last_name, u.email,
  u.phone_number, u.role, u.is_verified, u.created_at
FROM users u LEFT JOIN pk ON u.id = pk.id""")

_PF = ["name", "description", "stock", "status"]
_PK = ",\n  ".join(f"{_last(f, f'list_contains(present, {chr(39)}{f}{chr(39)})')} AS n_{f}, "
                   f"bool_or(list_contains(present, '{f}')) AS h_{f}" for f in _PF)
sql("patch_present", W("products product_patches", f"pk AS (SELECT id, {_PK} FROM product_patches GROUP BY id)") + """
SELECT p.id, p.seller_id, CASE WHEN pk.h_name THEN pk.n_name ELSE p.name END AS name, p.price,
  CASE WHEN pk.h_description THEN pk.n_description ELSE p.description END AS description,
  CASE WHEN pk.h_stock THEN pk.n_stock ELSE p.stock END AS stock,
  CASE WHEN pk.h_status THEN pk.n_status ELSE p.status END AS status, p.created_at
FROM products p LEFT JOIN pk ON p.id = pk.id""")

_PROF = ("""clash AS (SELECT DISTINCT ch.id, ch.change_ts, ch.seq FROM profile_changes ch
  JOIN users u ON ch.email = u.email AND u.id <> ch.id)""",
         """ok AS (SELECT ch.* FROM profile_changes ch WHERE NOT EXISTS (SELECT 1 FROM clash c
  WHERE c.id = ch.id AND c.change_ts = ch.change_ts AND c.seq = ch.seq))""",
         f"""pk AS (SELECT id, {_last('first_name', 'first_name IS NOT NULL')} AS nf,
  {_last('last_name', 'last_name IS NOT NULL')} AS nl, {_last('email', 'email IS NOT NULL')} AS ne,
  {_last('phone_number', 'phone_number IS NOT NULL')} AS np FROM ok GROUP BY id)""",
         """resets AS (SELECT DISTINCT ok.id FROM ok JOIN users u ON ok.id = u.id
  WHERE ok.email IS NULL OR ok.email <> u.email)""")
sql("profile_patch", W("users profile_changes", *_PROF) + """
SELECT u.id, COALESCE(pk.nf, u.first_name) AS first_name, COALESCE(pk.nl, u.last_name) AS last_name,
  COALESCE(pk.ne, u.email) AS email, COALESCE(pk.np, u.phone_number) AS phone_number, u.role,
  CASE WHEN u.id IN (SELECT id FROM resets) THEN FALSE ELSE u.is_verified END AS is_verified, u.created_at
FROM users u LEFT JOIN pk ON u.id = pk.id""")
sql("profile_patch_rejected", W("users profile_changes", *_PROF) + """
SELECT ch.*, 'email in use' AS reason FROM profile_changes ch
WHERE EXISTS (SELECT 1 FROM clash c WHERE c.id = ch.id AND c.change_ts = ch.change_ts AND c.seq = ch.seq)""")

# ---------------------------------------------------------------- M4 / M5 / M19 / M20
_UPS = ("""ch AS (SELECT c.*, p.price AS pprice, CASE WHEN p.id IS NULL THEN 'product not found'
  WHEN p.stock < c.quantity THEN 'not enough stock' END AS reason
  FROM cart_changes c LEFT JOIN products p ON c.product_id = p.id)""",
        f"""newcarts AS (SELECT DISTINCT {_key('cart', 'user_id')} AS id, user_id FROM ch
  WHERE reason IS NULL AND user_id NOT IN (SELECT user_id FROM carts))""",
        "allcarts AS (SELECT * FROM carts UNION ALL SELECT * FROM newcarts)",
        "cart_of AS (SELECT user_id, MIN(id) AS cart FROM allcarts GROUP BY user_id)",
        f"""last AS (SELECT user_id, product_id, {_last('quantity')} AS q, {_last('pprice')} AS pp,
  {_last('change_ts')} AS ts FROM ch WHERE reason IS NULL GROUP BY user_id, product_id)""",
        """lines AS (SELECT co.cart AS cart_id, l.product_id, l.q, l.pp, l.ts
  FROM last l JOIN cart_of co ON l.user_id = co.user_id)""")
_UPS_T = "carts cart_items products cart_changes"
sql("cart_upsert", W(_UPS_T, *_UPS) + """
SELECT COALESCE(ci.cart_id, ln.cart_id) AS cart_id, COALESCE(ci.product_id, ln.product_id) AS product_id,
  COALESCE(ln.q, ci.quantity) AS quantity, COALESCE(ln.pp, ci.price) AS price, COALESCE(ci.created_at, ln.ts) AS created_at
FROM cart_items ci FULL OUTER JOIN lines ln ON ci.cart_id = ln.cart_id AND ci.product_id = ln.product_id""")
sql("cart_upsert_rejected", W(_UPS_T, *_UPS) +
    "SELECT user_id, product_id, quantity, change_ts, seq, reason FROM ch WHERE reason IS NOT NULL")
sql("cart_upsert_carts", W(_UPS_T, *_UPS) + "SELECT * FROM allcarts")

_QU = ("""ch AS (SELECT q.*, p.price AS pprice,
  CASE WHEN c.id IS NULL OR ci.cart_id IS NULL OR p.id IS NULL THEN 'cart item not found'
       WHEN p.stock < q.quantity THEN 'not enough stock' END AS reason
  FROM cart_quantity_changes q LEFT JOIN carts c ON q.cart_id = c.id AND q.user_id = c.user_id
  LEFT JOIN cart_items ci ON q.cart_id = ci.cart_id AND q.product_id = ci.product_id
  LEFT JOIN products p ON q.product_id = p.id)""",
       f"""last AS (SELECT cart_id, product_id, {_last('quantity')} AS q, {_last('pprice')} AS pp
  FROM ch WHERE reason IS NULL GROUP BY cart_id, product_id)""")
_QU_T = "carts cart_items products cart_quantity_changes"
sql("cart_quantity_update", W(_QU_T, *_QU) + """
SELECT ci.cart_id, ci.product_id, COALESCE(l.q, ci.quantity) AS quantity, COALESCE(l.pp, ci.price) AS price,
  ci.created_at
FROM cart_items ci LEFT JOIN last l ON ci.cart_id = l.cart_id AND ci.product_id = l.product_id""")
sql("cart_quantity_rejected", W(_QU_T, *_QU) +
    "SELECT user_id, cart_id, product_id, quantity, change_ts, seq, reason FROM ch WHERE reason IS NOT NULL")
sql("cart_clear", W("carts cart_items cart_clear_requests") + """
SELECT * FROM cart_items WHERE cart_id NOT IN
  (SELECT id FROM carts WHERE user_id IN (SELECT user_id FROM cart_clear_requests))""")
sql("cart_create_missing", W("carts users") + f"""
SELECT * FROM carts UNION ALL
SELECT {_key('cart', 'id')}, id FROM users WHERE id NOT IN (SELECT user_id FROM carts)""")

# ---------------------------------------------------------------- M6 / M7 / M8
sql("replace_features", W("product_features feature_replacements emptied_feature_parents") + """
SELECT * FROM product_features WHERE product_id NOT IN
  (SELECT product_id FROM feature_replacements UNION SELECT product_id FROM emptied_feature_parents)
UNION ALL SELECT product_id, name, value FROM feature_replacements""")
sql("owned_delete", W("products sellers product_delete_requests") + """
SELECT * FROM products WHERE id NOT IN (
  SELECT r.id FROM product_delete_requests r JOIN products p ON r.id = p.id JOIN sellers s ON p.seller_id = s.id
  WHERE s.user_id = r.requester_id)""")

_CAS = ("roots AS (SELECT id AS root FROM users WHERE NOT is_verified)",
        """viol AS (
  SELECT r.root, 'shop_orders.user_id references users' AS reason FROM roots r
    WHERE EXISTS (SELECT 1 FROM shop_orders o WHERE o.user_id = r.root)
  UNION ALL SELECT r.root, 'shop_orders.address_id references addresses' FROM roots r
    WHERE EXISTS (SELECT 1 FROM shop_orders o JOIN addresses a ON o.address_id = a.id WHERE a.user_id = r.root)
  UNION ALL SELECT r.root, 'order_items.product_id references products' FROM roots r
    WHERE EXISTS (SELECT 1 FROM order_items oi JOIN products p ON oi.product_id = p.id
                  JOIN sellers s ON p.seller_id = s.id WHERE s.user_id = r.root))""",
        "rejected AS (SELECT root, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reason FROM viol GROUP BY root)",
        "accepted AS (SELECT root FROM roots WHERE root NOT IN (SELECT root FROM rejected))")
_CAS_T = "users shop_orders addresses order_items products sellers comments blogs"
sql("cascade_delete_rejected", W(_CAS_T, *_CAS) + "SELECT * FROM rejected")
sql("cascade_delete", W(_CAS_T, *_CAS) + "SELECT * FROM rejected")
sql("cascade_delete_users", W(_CAS_T, *_CAS) + "SELECT * FROM users WHERE id NOT IN (SELECT root FROM accepted)")
sql("cascade_delete_comments", W(_CAS_T, *_CAS) + """
SELECT c.id, CASE WHEN c.user_id IN (SELECT root FROM accepted) THEN NULL ELSE c.user_id END AS user_id,
  c.parent_type, c.parent_id, c.content, c.rating, c.status, c.created_at FROM comments c""")
sql("cascade_delete_addresses", W(_CAS_T, *_CAS) +
    "SELECT * FROM addresses WHERE user_id NOT IN (SELECT root FROM accepted)")
sql("cascade_delete_blogs", W(_CAS_T, *_CAS) + """
SELECT id, CASE WHEN author_id IN (SELECT root FROM accepted) THEN NULL ELSE author_id END AS author_id FROM blogs""")

_CROOTS = ("roots AS (SELECT c.id AS root FROM carts c JOIN users u ON c.user_id = u.id WHERE NOT u.is_verified)",)
sql("cascade_delete_cart_items", W("carts users cart_items", *_CROOTS) +
    "SELECT * FROM cart_items WHERE cart_id NOT IN (SELECT root FROM roots)")
sql("cascade_delete_carts", W("carts users", *_CROOTS) + "SELECT * FROM carts WHERE id NOT IN (SELECT root FROM roots)")
_AROOTS = ("roots AS (SELECT id AS root FROM addresses WHERE province = 'EUROPE')",
           """rejected AS (SELECT r.root, 'shop_orders.address_id references addresses' AS reason FROM roots r
  WHERE EXISTS (SELECT 1 FROM shop_orders o WHERE o.address_id = r.root))""")
sql("cascade_address_rejected", W("addresses shop_orders", *_AROOTS) + "SELECT * FROM rejected")
sql("cascade_address_remaining", W("addresses shop_orders", *_AROOTS) + """
SELECT * FROM addresses WHERE id NOT IN (SELECT root FROM roots WHERE root NOT IN (SELECT root FROM rejected))""")

# ---------------------------------------------------------------- M10 / M11 / M16
_ST = ("""ch AS (SELECT order_id, seller_user_id, CASE WHEN lower(status) = 'canceled' THEN 'cancelled'
  ELSE lower(status) END AS status, change_ts, seq FROM order_status_changes)""",
       """owned AS (SELECT DISTINCT oi.order_id, s.user_id FROM order_items oi JOIN products p ON oi.product_id = p.id
  JOIN sellers s ON p.seller_id = s.id)""",
       """flag AS (SELECT ch.*, CASE WHEN NOT EXISTS (SELECT 1 FROM owned w WHERE w.order_id = ch.order_id
  AND w.user_id = ch.seller_user_id) THEN 'order not found or not owned'
  WHEN ch.status NOT IN ('pending', 'processing', 'shipped', 'delivered', 'cancelled') THEN 'invalid status' END
  AS reason FROM ch)""",
       f"last AS (SELECT order_id, {_last('status')} AS status FROM flag WHERE reason IS NULL GROUP BY order_id)")
_ST_T = "shop_orders order_items products sellers order_status_changes"
sql("order_status_change", W(_ST_T, *_ST) + """
SELECT o.id, o.user_id, o.address_id, o.total_amount, COALESCE(l.status, o.status) AS status, o.created_at
FROM shop_orders o LEFT JOIN last l ON o.id = l.order_id""")
sql("order_status_rejected", W(_ST_T, *_ST) + "SELECT * FROM flag WHERE reason IS NOT NULL")

_MOD = ("valid AS (SELECT * FROM comment_moderation WHERE status IN ('pending', 'approved', 'rejected'))",
        f"last AS (SELECT comment_id, {_last('status')} AS status FROM valid GROUP BY comment_id)",
        """newc AS (SELECT c.id, c.parent_type, c.parent_id, c.rating, COALESCE(l.status, c.status) AS status
  FROM comments c LEFT JOIN last l ON c.id = l.comment_id)""")
sql("moderate_comments", W("comments comment_moderation", *_MOD) + "SELECT * FROM newc")
_RATING = ("CASE WHEN COUNT(*) > 0 THEN CAST(CAST((200 * SUM(c.rating) + COUNT(*)) // (2 * COUNT(*)) "
           "AS DECIMAL(20,0)) * 0.01 AS DECIMAL(3,2)) END")
sql("moderated_ratings", W(
    "comments comment_moderation", *_MOD,
    "touched AS (SELECT DISTINCT parent_type, parent_id FROM comments WHERE id IN (SELECT comment_id FROM valid))",
    f"""r AS (SELECT c.parent_type, c.parent_id, COUNT(*) AS n, {_RATING} AS avg_r FROM newc c
      WHERE c.status = 'approved' GROUP BY c.parent_type, c.parent_id)""") + """
SELECT t.parent_type, t.parent_id, COALESCE(r.n, 0) AS n_ratings,
  COALESCE(r.avg_r, CAST(0 AS DECIMAL(3,2))) AS average_rating
FROM touched t LEFT JOIN r ON t.parent_type = r.parent_type AND t.parent_id = r.parent_id""")

# ---------------------------------------------------------------- M17
_PRO = ("""r AS (SELECT q.* FROM seller_requests q WHERE q.user_id IN (SELECT id FROM users)
  AND q.user_id NOT IN (SELECT user_id FROM sellers WHERE user_id IS NOT NULL)
  AND q.shop_name NOT IN (SELECT shop_name FROM sellers))""",
        """acc AS (SELECT * EXCLUDE (rn) FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY shop_name
  ORDER BY change_ts, seq) rn FROM r) WHERE rn = 1)""")
_PRO_T = "users sellers seller_requests"
sql("promote_sellers", W(_PRO_T, *_PRO) + f"""
SELECT * FROM sellers UNION ALL
SELECT {_key('seller', 'user_id')}, user_id, shop_name, CAST(0 AS DECIMAL(3,2)), 'active', DATE '2024-01-20' FROM acc""")
sql("promote_sellers_rejected", W(_PRO_T, *_PRO) + """
SELECT q.*, CASE WHEN q.user_id NOT IN (SELECT id FROM users) THEN 'user not found'
  WHEN q.user_id IN (SELECT user_id FROM sellers WHERE user_id IS NOT NULL) THEN 'user is already a seller'
  ELSE 'shop name is already taken' END AS reason
FROM seller_requests q WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.user_id = q.user_id AND a.seq = q.seq)""")
sql("promote_sellers_users", W(_PRO_T, *_PRO) +
    "SELECT id, CASE WHEN id IN (SELECT user_id FROM acc) THEN 'seller' ELSE role END AS role FROM users")

# ---------------------------------------------------------------- Q36 registration
_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
_REG_RULES = [
    ("required", "first_name", "first_name IS NULL", "NULL"),
    ("length", "first_name", "length(first_name) < 2 OR length(first_name) > 50", "first_name"),
    ("required", "last_name", "last_name IS NULL", "NULL"),
    ("length", "last_name", "length(last_name) < 2 OR length(last_name) > 50", "last_name"),
    ("required", "email", "email IS NULL", "NULL"),
    ("email", "email", f"NOT regexp_matches(email, '{_EMAIL}')", "email"),
    ("required", "phone_number", "phone_number IS NULL", "NULL"),
    ("mobile", "phone_number", "NOT regexp_matches(phone_number, '^09[0-9]{9}$')", "phone_number"),
    ("required", "password", "password IS NULL", "NULL"),
    ("length", "password", "length(password) < 8 OR length(password) > 100", "password"),
    ("password", "password", "NOT (regexp_matches(password, '[a-z]') AND regexp_matches(password, '[A-Z]') "
     "AND regexp_matches(password, '[0-9]') AND regexp_matches(password, '^[a-zA-Z0-9]{8,}$'))", "password"),
]
_VIOL = "\nUNION ALL ".join(
    f"SELECT '{r}' AS rule, 'registrations' AS \"table\", CAST(request_id AS VARCHAR) AS key, '{c}' AS \"column\", "
    f"CAST({v} AS VARCHAR) AS value FROM registrations WHERE {c} IS NOT NULL AND ({cond})"
    if r != "required" else
    f"SELECT '{r}' AS rule, 'registrations' AS \"table\", CAST(request_id AS VARCHAR) AS key, "
    f"'{c}' AS \"column\", CAST(NULL AS VARCHAR) AS value FROM registrations WHERE {cond}"
    for r, c, cond, v in _REG_RULES)
_REG = (f"viol AS ({_VIOL})",
        "valid AS (SELECT * FROM registrations WHERE CAST(request_id AS VARCHAR) NOT IN (SELECT key FROM viol))",
        """conflicts AS (SELECT v.request_id, 'email' AS key, v.email AS value, u.id AS conflicting_id
  FROM valid v JOIN users u ON v.email = u.email
  UNION ALL SELECT v.request_id, 'phone_number', v.phone_number, u.id FROM valid v
  JOIN users u ON v.phone_number = u.phone_number)""")
sql("validate_registrations", W("registrations users", *_REG) + "SELECT * FROM viol")
sql("email_conflicts", W("registrations users", *_REG) + "SELECT * FROM conflicts")
sql("register_users", W("registrations users", *_REG) + f"""
SELECT {_key('user', 'request_id')} AS id, first_name, last_name, email, phone_number, 'customer' AS role,
  FALSE AS is_verified, DATE '2024-01-20' AS created_at
FROM valid WHERE request_id NOT IN (SELECT request_id FROM conflicts)""")

# ---------------------------------------------------------------- S3 / M21 / C10 / C11
_DOCS = ("""docs AS (SELECT o.o_orderkey AS doc_id, o.o_custkey AS user_id,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '5-LOW' THEN 'cash' ELSE 'bank_transfer' END
    AS payment_method,
  (SELECT COUNT(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_items FROM orders o)""",
         "valid AS (SELECT * FROM docs WHERE payment_method IN ('credit_card', 'bank_transfer') AND n_items > 0)")
sql("validate_payloads", "WITH " + ",\n".join(_DOCS) + """
SELECT 'allowed' AS rule, 'order_documents' AS "table", CAST(doc_id AS VARCHAR) AS key,
  'payment_method' AS "column", payment_method AS value
FROM docs WHERE payment_method NOT IN ('credit_card', 'bank_transfer')
UNION ALL SELECT 'required', 'order_documents', CAST(doc_id AS VARCHAR), 'items', CAST(NULL AS VARCHAR)
FROM docs WHERE n_items = 0""")
sql("place_orders", "WITH " + ",\n".join(_DOCS) + f"""
SELECT {_key('order', 'v.doc_id')} AS id, v.user_id, CAST(v.user_id AS VARCHAR) AS address_id,
  CAST(SUM(CAST(l.l_quantity AS INT) * CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS total_amount,
  'pending' AS status, v.payment_method, v.doc_id
FROM valid v JOIN lineitem l ON l.l_orderkey = v.doc_id GROUP BY v.doc_id, v.user_id, v.payment_method""")
sql("place_orders_items", "WITH " + ",\n".join(_DOCS) + f"""
SELECT {_key('order', 'l.l_orderkey')} AS order_id,
  ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, CAST(l.l_quantity AS INT),
    CAST(l.l_extendedprice AS DECIMAL(12,2))) AS line_no,
  CAST(l.l_partkey AS VARCHAR) AS product_id, CAST(l.l_quantity AS INT) AS quantity,
  CAST(l.l_extendedprice AS DECIMAL(12,2)) AS price_at_time, l.l_orderkey AS doc_id
FROM lineitem l WHERE l.l_orderkey IN (SELECT doc_id FROM valid)""")

# ---------------------------------------------------------------- Q11 / Q24 / Q30 / Q34 / Q5
_REN = ("""clash AS (SELECT ch.*, 'name already in use' AS reason FROM seller_renames ch
  WHERE EXISTS (SELECT 1 FROM sellers s WHERE s.shop_name = ch.shop_name AND s.id <> ch.id))""",
        """ranked AS (SELECT ch.*, ROW_NUMBER() OVER (PARTITION BY shop_name ORDER BY change_ts, seq) AS rn
  FROM seller_renames ch WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.id = ch.id AND c.seq = ch.seq))""",
        f"""pk AS (SELECT id, {_last('shop_name', 'shop_name IS NOT NULL')} AS nn FROM ranked WHERE rn = 1
  GROUP BY id)""")
sql("seller_rename", W("sellers seller_renames", *_REN) + """
SELECT s.id, s.user_id, COALESCE(pk.nn, s.shop_name) AS shop_name, s.rating, s.status, s.created_at
FROM sellers s LEFT JOIN pk ON s.id = pk.id""")
sql("seller_rename_rejected", W("sellers seller_renames", *_REN) + """
SELECT * FROM clash UNION ALL
SELECT id, shop_name, change_ts, seq, 'name already in use' FROM ranked WHERE rn > 1""")

_CC = ("""clash AS (SELECT n.*, 'name already in use' AS reason FROM new_categories n
  WHERE EXISTS (SELECT 1 FROM categories c WHERE c.fa_name = n.fa_name AND c.en_name = n.en_name))""",
       """fresh AS (SELECT n.*, ROW_NUMBER() OVER (PARTITION BY fa_name, en_name ORDER BY change_ts, seq) AS rn
  FROM new_categories n WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.fa_name = n.fa_name
  AND c.en_name = n.en_name))""")
sql("category_create", W("categories new_categories", *_CC) + """
SELECT * FROM categories UNION ALL
SELECT sha256('category:' || fa_name || ':' || en_name), en_name, fa_name FROM fresh WHERE rn = 1""")
sql("category_create_rejected", W("categories new_categories", *_CC) + """
SELECT * FROM clash UNION ALL SELECT fa_name, en_name, change_ts, seq, 'name already in use' FROM fresh WHERE rn > 1""")

_COM = ("""j AS (SELECT n.*, CASE WHEN n.parent_type NOT IN ('blog', 'product') THEN 'invalid parent type'
  WHEN NOT ((n.parent_type = 'product' AND EXISTS (SELECT 1 FROM products p WHERE p.id = n.parent_id))
         OR (n.parent_type = 'blog' AND EXISTS (SELECT 1 FROM blogs b WHERE b.id = n.parent_id))) THEN 'parent not found'
  WHEN n.rating IS NULL OR n.rating < 1 OR n.rating > 5 THEN 'invalid rating'
  WHEN n.content IS NULL OR length(n.content) < 2 OR length(n.content) > 1000 THEN 'invalid content' END AS reason
  FROM new_comments n)""",)
sql("comment_create", W("comments products blogs users new_comments", *_COM) + f"""
SELECT {_key('comment', 'user_id', 'epoch_us(change_ts)', 'seq')} AS id, user_id, parent_type, parent_id, content,
  rating, CASE WHEN user_id IN (SELECT id FROM users WHERE role = 'admin') THEN 'approved' ELSE 'pending' END AS status, change_ts AS created_at FROM j WHERE reason IS NULL""")
sql("comment_append", ORACLE["comment_create"])
sql("comment_create_rejected", W("comments products blogs new_comments", *_COM) + "SELECT * FROM j WHERE reason IS NOT NULL")

sql("category_update", W("categories category_changes") + """
SELECT categories.* REPLACE (coalesce(category_changes.fa_name, categories.fa_name) AS fa_name,
  coalesce(category_changes.en_name, categories.en_name) AS en_name)
FROM categories LEFT JOIN category_changes ON category_changes.id = categories.id""")
sql("category_update_rejected", W("categories category_changes") +
    "SELECT *, 'not found' AS reason FROM category_changes WHERE id NOT IN (SELECT id FROM categories)")
_OWN_ADDRESS = """mine AS (SELECT wish.id FROM address_deletions AS wish
  INNER JOIN addresses ON addresses.id = wish.id AND addresses.user_id = wish.requester_id)"""
sql("address_delete", W("addresses address_deletions", _OWN_ADDRESS) +
    "SELECT * FROM addresses WHERE id NOT IN (SELECT id FROM mine)")
sql("address_delete_rejected", W("addresses address_deletions", _OWN_ADDRESS) +
    "SELECT * FROM address_deletions WHERE id NOT IN (SELECT id FROM mine)")
sql("cart_quantity_touched", W(_QU_T, *_QU) + f"""
SELECT carts.id, carts.user_id, CASE WHEN carts.id IN (SELECT cart_id FROM last) THEN {TS} END AS updated_at FROM carts""")
sql("moderate_comments_rejected", W("comments staged_comments") + """
SELECT staged_comments.id * 2 AS comment_id, staged_comments.status, staged_comments.id AS seq,
  CASE WHEN staged_comments.status NOT IN ('pending', 'approved', 'rejected') THEN 'invalid status'
       ELSE 'comment not found' END AS reason
FROM staged_comments LEFT JOIN comments ON comments.id = staged_comments.id * 2
WHERE staged_comments.status NOT IN ('pending', 'approved', 'rejected') OR comments.id IS NULL""")

sql("address_create", W("addresses new_addresses", f"""ins AS (SELECT {_key('address', 'user_id', 'epoch_us(change_ts)', 'seq')} AS id, user_id,
  address, city, province, postal_code, is_default, CAST(change_ts AS DATE) AS created_at, change_ts, seq
  FROM new_addresses)""",
    """allr AS (SELECT id, user_id, address, city, province, postal_code, is_default, created_at FROM addresses
  UNION ALL SELECT id, user_id, address, city, province, postal_code, is_default, created_at FROM ins)""",
    f"chosen AS (SELECT user_id, {_last('id')} AS id FROM ins WHERE is_default GROUP BY user_id)") + """
SELECT a.id, a.user_id, a.address, a.city, a.province, a.postal_code,
  CASE WHEN c.user_id IS NOT NULL THEN a.id = c.id ELSE a.is_default END AS is_default, a.created_at
FROM allr a LEFT JOIN chosen c ON a.user_id = c.user_id""")

_PD = ("""docs AS (SELECT p.p_partkey AS doc_id, pr.seller_id, p.p_name AS name,
  CASE WHEN p.p_size = 1 THEN 0 ELSE CAST(ROUND(p.p_retailprice * 100) AS BIGINT) END AS price,
  p.p_name || ' ' || p.p_type AS description, CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE p.p_size END AS stock,
  p.p_size, p.p_type, p.p_brand FROM part p JOIN products pr ON pr.id = p.p_partkey)""",
       f"valid AS (SELECT *, {_key('product', 'doc_id')} AS pid FROM docs WHERE price > 0 AND p_size <> 2)")
sql("create_products", W("products", *_PD) + """
SELECT pid AS id, seller_id, name, price, description, COALESCE(stock, 0) AS stock, 'active' AS status FROM valid""")
sql("create_products_bridge", W("products", *_PD) + """
SELECT pid AS product_id, p_type AS category_id FROM valid UNION ALL SELECT pid, p_brand FROM valid""")
sql("create_products_features", W("products", *_PD) + "SELECT pid AS product_id, 'brand' AS name, p_brand AS value FROM valid")
sql("validate_products", W("products", *_PD) + """
SELECT 'range' AS rule, 'product_documents' AS "table", CAST(doc_id AS VARCHAR) AS key, 'price' AS "column",
  CAST(price AS VARCHAR) AS value FROM docs WHERE price <= 0
UNION ALL SELECT 'array_size', 'product_documents', CAST(doc_id AS VARCHAR), 'categories', '0' FROM docs WHERE p_size = 2""")

sql("category_list", W("categories") + "SELECT * FROM categories")

_CD = ("""dels AS (SELECT DISTINCT c.id FROM comment_deletions d JOIN comments c ON c.id = d.id
  WHERE c.user_id = d.requester_id OR COALESCE(d.is_admin, FALSE))""",
       "rest AS (SELECT * FROM comments WHERE id NOT IN (SELECT id FROM dels))",
       "touched AS (SELECT DISTINCT parent_type, parent_id FROM comments WHERE id IN (SELECT id FROM dels))",
       f"""r AS (SELECT c.parent_type, c.parent_id, COUNT(*) AS n, {_RATING} AS avg_r FROM rest c
  WHERE c.status = 'approved' GROUP BY c.parent_type, c.parent_id)""")
sql("comment_delete", W("comments comment_deletions", *_CD) + "SELECT * FROM rest")
sql("comment_delete_ratings", W("comments comment_deletions", *_CD) + """
SELECT t.parent_type, t.parent_id, COALESCE(r.n, 0) AS n_ratings, COALESCE(r.avg_r, CAST(0 AS DECIMAL(3,2))) AS average_rating
FROM touched t LEFT JOIN r ON t.parent_type = r.parent_type AND t.parent_id = r.parent_id""")

_CR = ("""ok AS (SELECT DISTINCT q.cart_id, q.product_id FROM cart_removals q
  JOIN carts c ON q.cart_id = c.id AND q.user_id = c.user_id
  JOIN cart_items ci ON q.cart_id = ci.cart_id AND q.product_id = ci.product_id)""",)
sql("cart_remove", W("carts cart_items cart_removals", *_CR) + """
SELECT * FROM cart_items ci WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.cart_id = ci.cart_id
  AND ok.product_id = ci.product_id)""")
sql("cart_remove_rejected", W("carts cart_items cart_removals", *_CR) + """
SELECT q.* FROM cart_removals q WHERE NOT EXISTS (SELECT 1 FROM carts c WHERE c.id = q.cart_id AND c.user_id = q.user_id)
  OR NOT EXISTS (SELECT 1 FROM cart_items ci WHERE ci.cart_id = q.cart_id AND ci.product_id = q.product_id)""")

_OWNS = """EXISTS (SELECT 1 FROM products x JOIN sellers s ON x.seller_id = s.id
  WHERE x.id = r.id AND s.user_id = r.requester_id)"""
_PF2 = ["name", "price", "description", "stock", "status"]
_PK2 = ",\n  ".join(f"{_last(f, f'list_contains(present, {chr(39)}{f}{chr(39)})')} AS n_{f}, "
                    f"bool_or(list_contains(present, '{f}')) AS h_{f}" for f in _PF2)
_PU = (f"""ok AS (SELECT r.* FROM product_update_patches r WHERE r.id IN (SELECT id FROM products)
  AND (COALESCE(r.is_admin, FALSE) OR {_OWNS}))""",
       f"""refused AS (SELECT r.id, r.requester_id, r.seq, 'not found or not owner' AS reason
  FROM product_update_patches r WHERE NOT (COALESCE(r.is_admin, FALSE) OR {_OWNS}))""",
       f"pk AS (SELECT id, {_PK2} FROM ok GROUP BY id)")
_PU_T = "products sellers users product_update_patches product_categories product_features"
sql("product_update", W(_PU_T, *_PU) + """
SELECT p.id, p.seller_id, CASE WHEN pk.h_name THEN pk.n_name ELSE p.name END AS name,
  CASE WHEN pk.h_price THEN pk.n_price ELSE p.price END AS price,
  CASE WHEN pk.h_description THEN pk.n_description ELSE p.description END AS description,
  CASE WHEN pk.h_stock THEN pk.n_stock ELSE p.stock END AS stock,
  CASE WHEN pk.h_status THEN pk.n_status ELSE p.status END AS status, p.created_at
FROM products p LEFT JOIN pk ON p.id = pk.id""")
sql("product_update_rejected", W(_PU_T, *_PU) + "SELECT * FROM refused")


def _replace_twin(lists: str, table: str, cols: str, first_col: str) -> str:
    return W(_PU_T + " " + lists, *_PU,
             f"""mine AS (SELECT l.* FROM {lists} l WHERE EXISTS (SELECT 1 FROM ok
  WHERE ok.id = l.product_id AND ok.change_ts = l.change_ts AND ok.seq = l.seq))""",
             """lastl AS (SELECT product_id, change_ts, seq FROM (SELECT DISTINCT product_id, change_ts, seq,
  DENSE_RANK() OVER (PARTITION BY product_id ORDER BY change_ts DESC, seq DESC) AS rk FROM mine) WHERE rk = 1)""") + f"""
SELECT * FROM {table} WHERE product_id NOT IN (SELECT product_id FROM lastl)
UNION ALL SELECT m.product_id, {cols} FROM mine m JOIN lastl USING (product_id, change_ts, seq)
WHERE m.{first_col} IS NOT NULL"""


sql("product_update_bridge", _replace_twin("product_update_categories", "product_categories", "m.category_id",
                                           "category_id"))
sql("product_update_features", _replace_twin("product_update_features", "product_features", "m.name, m.value", "name"))

_PDEL = ("""owners AS MATERIALIZED (SELECT DISTINCT products.id AS owned_id, sellers.user_id AS owner
  FROM sellers INNER JOIN products ON products.seller_id = sellers.id)""",
         """asked AS MATERIALIZED (SELECT request.id, owner IS NOT NULL AS allowed FROM product_delete_batch AS request
  LEFT JOIN owners ON owned_id = request.id AND owner = request.requester_id)""",
         """ordered AS MATERIALIZED (SELECT product_id FROM order_items GROUP BY product_id)""",
         """blocked AS (SELECT DISTINCT id FROM asked INNER JOIN ordered ON product_id = id WHERE allowed)""")
_PDEL_T = "products sellers order_items product_delete_batch"
sql("product_delete_refused", W(_PDEL_T, *_PDEL) + """
SELECT id, 'not found or not owner' AS reason FROM asked WHERE NOT allowed
UNION ALL SELECT id, 'order_items.product_id references products' FROM blocked""")
sql("product_delete_products", W(_PDEL_T, *_PDEL) + """
SELECT products.* FROM products
LEFT JOIN (SELECT DISTINCT id AS gone FROM asked WHERE allowed) ON gone = products.id
LEFT JOIN blocked ON blocked.id = products.id WHERE gone IS NULL OR blocked.id IS NOT NULL""")
_AU = ("""ok AS (SELECT c.* FROM address_changes c WHERE EXISTS (SELECT 1 FROM addresses a
  WHERE a.id = c.id AND a.user_id = c.user_id))""",
       f"""pk AS (SELECT id, {_last('address', 'address IS NOT NULL')} AS na, {_last('city', 'city IS NOT NULL')} AS nc,
  {_last('is_default', 'is_default IS NOT NULL')} AS nd FROM ok GROUP BY id)""",
       f"""lt AS (SELECT user_id, {_last('id', 'is_default')} AS tid,
  max(change_ts) FILTER (WHERE is_default) AS tts FROM ok GROUP BY user_id HAVING bool_or(is_default))""",
       """lt2 AS (SELECT lt.user_id, lt.tid, (SELECT max(seq) FROM ok WHERE ok.user_id = lt.user_id AND ok.is_default
  AND ok.change_ts = lt.tts) AS tseq, lt.tts FROM lt)""",
       """killed AS (SELECT DISTINCT ok.user_id FROM ok JOIN lt2 ON ok.user_id = lt2.user_id AND ok.id = lt2.tid
  WHERE NOT ok.is_default AND (ok.change_ts > lt2.tts OR (ok.change_ts = lt2.tts AND ok.seq > lt2.tseq)))""")
sql("address_update", W("addresses address_changes", *_AU) + """
SELECT a.id, a.user_id, COALESCE(pk.na, a.address) AS address, COALESCE(pk.nc, a.city) AS city, a.province,
  a.postal_code,
  CASE WHEN lt2.user_id IS NOT NULL THEN a.id = lt2.tid AND a.user_id NOT IN (SELECT user_id FROM killed)
       ELSE COALESCE(pk.nd, a.is_default) END AS is_default, a.created_at
FROM addresses a LEFT JOIN pk ON a.id = pk.id LEFT JOIN lt2 ON a.user_id = lt2.user_id""")
sql("address_update_rejected", W("addresses address_changes") + """
SELECT c.*, 'address not found' AS reason FROM address_changes c
WHERE NOT EXISTS (SELECT 1 FROM addresses a WHERE a.id = c.id AND a.user_id = c.user_id)""")
sql("first_image_flag_owned", W("product_images owned_uploads products sellers") + """
SELECT product_id, image_url, change_ts, seq, requester_id,
  (rn = 1 AND NOT EXISTS (SELECT 1 FROM product_images pi WHERE pi.product_id = r.product_id)) AS is_main
FROM (SELECT u.*, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY change_ts, seq) rn FROM owned_uploads u
      WHERE EXISTS (SELECT 1 FROM products p JOIN sellers s ON p.seller_id = s.id
                    WHERE p.id = u.product_id AND s.user_id = u.requester_id)) r""")
sql("live_tokens",W("refresh_tokens") + f"""
SELECT * FROM refresh_tokens WHERE NOT COALESCE(is_revoked, FALSE) AND expires_at > {TS}""")

_BAD_BLOG ="title IS NULL OR length(title) < 3 OR length(title) > 255 OR content IS NULL"
sql("blog_create", W("new_blogs") + f"""
SELECT {_key('blog', 'author_id', 'epoch_us(change_ts)', 'seq')} AS id, author_id, title, COALESCE(en_title, title) AS en_title, content,
  0 AS views, change_ts AS created_at FROM new_blogs WHERE NOT ({_BAD_BLOG})""")
sql("blog_create_rejected", W("new_blogs") + f"""
SELECT author_id, title, seq, 'invalid title or content' AS reason FROM new_blogs WHERE {_BAD_BLOG}""")

sql("orders_deep_page", W("shop_orders") + """
SELECT * FROM shop_orders ORDER BY total_amount DESC NULLS FIRST, id LIMIT 100 OFFSET 1000""")

# ---------------------------------------------------------------- streaming twins (batch form)
sql("stream_ratings", W("comments") + f"""
SELECT c.parent_type, c.parent_id, COUNT(*) AS n_ratings, {_RATING} AS average_rating
FROM comments c WHERE c.status = 'approved' GROUP BY c.parent_type, c.parent_id""")
sql("stream_window_counts", """
SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
  time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, COUNT(*) AS n, COUNT(*) > 1500 AS over_limit
FROM events GROUP BY user_id, time_bucket(INTERVAL 15 MINUTE, ts)""")
sql("stream_sliding_attempts", W("email_verifications") + """
SELECT user_id, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, COUNT(*) AS n, COUNT(*) >= 5 AS at_limit
FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, created_at) - INTERVAL 5 MINUTE * CAST(k AS INTEGER) AS ws
      FROM email_verifications CROSS JOIN range(0, 12) AS r(k)) x
GROUP BY user_id, ws""")
sql("stream_moderation", W("comments comment_moderation", *_MOD) + f"""
SELECT c.parent_type, c.parent_id, COUNT(*) AS n_ratings, {_RATING} AS average_rating
FROM newc c WHERE c.status = 'approved' GROUP BY c.parent_type, c.parent_id""")
# Applying the change feed batch by batch must equal applying it at once.
sql("stream_apply_changes", ORACLE["patch_coalesce"])
sql("stream_expiry", W("refresh_tokens") + """
SELECT * FROM refresh_tokens
WHERE NOT (expires_at < (SELECT MAX(created_at) FROM refresh_tokens) OR COALESCE(is_revoked, FALSE))""")
# The rate limit is a recurrence over each user's requests in order, with the accepted times of the last day.
sql("stream_rate_limited_codes", W("email_verifications",
    """n AS (SELECT user_id, created_at AS ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at, id) AS k
  FROM email_verifications)""",
    """r AS (SELECT user_id, ts, k, TRUE AS accepted, CAST(0 AS BIGINT) AS recent, [ts] AS kept FROM n WHERE k = 1
  UNION ALL
  SELECT user_id, ts, k, len(live) < 5, CAST(len(live) AS BIGINT),
    CASE WHEN len(live) < 5 THEN list_append(live, ts) ELSE live END
  FROM (SELECT n.*, list_filter(r.kept, lambda x: x > n.ts - INTERVAL 1 DAY) AS live
        FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1) s)""").replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT user_id, ts, accepted, recent FROM r""")
sql("stream_enrich", W("comments users products blogs") + """
SELECT c.*, u.first_name AS author_first_name, u.last_name AS author_last_name, p.name AS parent_name,
  b.title AS parent_title
FROM comments c LEFT JOIN users u ON c.user_id = u.id
LEFT JOIN products p ON c.parent_type = 'product' AND c.parent_id = p.id
LEFT JOIN blogs b ON c.parent_type = 'blog' AND c.parent_id = b.id""")

# ---------------------------------------------------------------- audits
_UQ = [("users", "email", "id"), ("users", "phone_number", "id"), ("sellers", "shop_name", "id"),
       ("refresh_tokens", "token", "id")]
_UQ_SQL = [f"""SELECT 'unique' AS rule, '{t}' AS "table", CAST({k} AS VARCHAR) AS key, '{c}' AS "column",
  CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IN (SELECT {c} FROM {t} GROUP BY {c} HAVING COUNT(*) > 1)"""
           for t, c, k in _UQ]
_UQ_SQL.append("""SELECT 'unique', 'categories', CAST(id AS VARCHAR), 'fa_name,en_name', fa_name || '|' || en_name
  FROM categories WHERE (fa_name, en_name) IN (SELECT fa_name, en_name FROM categories GROUP BY 1, 2 HAVING COUNT(*) > 1)""")
_UQ_SQL.append("""SELECT 'unique', 'product_categories', CAST(product_id AS VARCHAR) || '|' || CAST(category_id AS VARCHAR),
  'product_id,category_id', CAST(product_id AS VARCHAR) || '|' || CAST(category_id AS VARCHAR)
  FROM product_categories WHERE (product_id, category_id) IN
  (SELECT product_id, category_id FROM product_categories GROUP BY 1, 2 HAVING COUNT(*) > 1)""")
_UQ_SQL.append("""SELECT 'unique', 'order_items', CAST(order_id AS VARCHAR), 'order_id,line_no',
  CAST(order_id AS VARCHAR) || '|' || CAST(line_no AS VARCHAR)
  FROM order_items WHERE (order_id, line_no) IN (SELECT order_id, line_no FROM order_items GROUP BY 1, 2 HAVING COUNT(*) > 1)""")
sql("audit_keys", W("users sellers refresh_tokens categories product_categories order_items") +
    "\nUNION ALL ".join(_UQ_SQL))

# (child, fk, parent, child has an id column)
_FK = [("sellers", "user_id", "users", True), ("products", "seller_id", "sellers", True),
       ("product_images", "product_id", "products", True), ("product_features", "product_id", "products", False),
       ("carts", "user_id", "users", True), ("cart_items", "cart_id", "carts", False),
       ("cart_items", "product_id", "products", False), ("blogs", "author_id", "users", True),
       ("comments", "user_id", "users", True), ("email_verifications", "user_id", "users", True),
       ("product_categories", "product_id", "products", False),
       ("product_categories", "category_id", "categories", False), ("addresses", "user_id", "users", True),
       ("shop_orders", "user_id", "users", True), ("shop_orders", "address_id", "addresses", True),
       ("order_items", "order_id", "shop_orders", False), ("order_items", "product_id", "products", False),
       ("refresh_tokens", "user_id", "users", True), ("staged_comments", "user_id", "users", True),
       ("staged_lines", "product_id", "products", False)]
_FK_SQL = "\nUNION ALL ".join(
    f"""SELECT 'foreign_key' AS rule, '{c}' AS "table", CAST({'id' if has_id else fk} AS VARCHAR) AS key,
  '{fk}' AS "column", CAST({fk} AS VARCHAR) AS value FROM {c} x
  WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id = x.{fk})"""
    for c, fk, p, has_id in _FK)
sql("audit_orphans", W(" ".join(sorted({t for c, _, p, _ in _FK for t in (c, p)}))) + _FK_SQL)

sql("audit_polymorphic", W("comments staged_comments products blogs", """every AS (
  SELECT id, parent_type, parent_id FROM comments UNION ALL SELECT id, parent_type, parent_id FROM staged_comments)""",
  """there AS (SELECT 'product' AS kind, id AS there_id FROM products UNION ALL SELECT 'blog', id FROM blogs)""") + """
SELECT 'parent_exists' AS rule, 'comments' AS "table", CAST(id AS VARCHAR) AS key,
  'parent_type:' || parent_type AS "column", CAST(parent_id AS VARCHAR) AS value
FROM every LEFT JOIN there ON kind = parent_type AND there_id = parent_id
WHERE parent_type IN ('product', 'blog') AND there_id IS NULL""")

_DOM = []
for t in ["users", "staged_users"]:
    for col in ["first_name", "last_name", "email", "phone_number", "role"]:
        _DOM.append(f"""SELECT 'not_null' AS rule, '{t}' AS "table", CAST(id AS VARCHAR) AS key, '{col}' AS "column",
  CAST(NULL AS VARCHAR) AS value FROM {t} WHERE {col} IS NULL""")
for t, col, dom in [("users", "role", "'admin','seller','customer'"), ("sellers", "status", "'active','pending','suspended'"),
                    ("products", "status", "'active','inactive','out_of_stock'"),
                    ("comments", "status", "'pending','approved','rejected'"),
                    ("comments", "parent_type", "'blog','product'"),
                    ("staged_users", "role", "'admin','seller','customer'"),
                    ("staged_comments", "status", "'pending','approved','rejected'"),
                    ("staged_comments", "parent_type", "'blog','product'"),
                    ("shop_orders", "status", "'pending','processing','shipped','delivered','cancelled'")]:
    _DOM.append(f"SELECT 'enum', '{t}', CAST(id AS VARCHAR), '{col}', {col} FROM {t} "
                f"WHERE {col} IS NOT NULL AND {col} NOT IN ({dom})")
for t, col, cond, key in [("comments", "rating", "rating < 1 OR rating > 5", "id"),
                          ("staged_comments", "rating", "rating < 1 OR rating > 5", "id"),
                          ("products", "price", "price <= 0", "id"), ("products", "stock", "stock < 0", "id"),
                          ("staged_lines", "quantity", "quantity < 1", "order_id"),
                          ("staged_lines", "price_at_time", "price_at_time <= 0", "order_id"),
                          ("cart_items", "quantity", "quantity < 1", "cart_id")]:
    _DOM.append(f"SELECT 'range', '{t}', CAST({key} AS VARCHAR), '{col}', CAST({col} AS VARCHAR) FROM {t} "
                f"WHERE {col} IS NOT NULL AND ({cond})")
for t, col, lo, hi in [("sellers", "shop_name", 3, 255), ("blogs", "title", 3, 255), ("categories", "en_name", 3, 255),
                       ("comments", "content", 2, 1000), ("staged_comments", "content", 2, 1000)]:
    _DOM.append(f"SELECT 'length', '{t}', CAST(id AS VARCHAR), '{col}', {col} FROM {t} "
                f"WHERE {col} IS NOT NULL AND (length({col}) < {lo} OR length({col}) > {hi})")
sql("audit_domains", W("users sellers products comments shop_orders cart_items blogs categories staged_users "
                        "staged_comments staged_lines") + "\nUNION ALL ".join(_DOM))



def _violation(rule: str, table: str, key: str, column: str, condition: str) -> str:
    return (f"SELECT '{rule}' AS rule, '{table}' AS \"table\", CAST({key} AS VARCHAR) AS key, '{column}' AS \"column\", "
            f"CAST({column} AS VARCHAR) AS value FROM {table} WHERE {condition}")


_PAY = [_violation("range", "staged_comments", "id", "rating", "rating NOT BETWEEN 1 AND 5"),
        _violation("required", "staged_comments", "id", "rating", "rating IS NULL"),
        _violation("range", "staged_lines", "order_id", "quantity", "quantity < 1"),
        _violation("required", "staged_lines", "order_id", "quantity", "quantity IS NULL"),
        _violation("required", "staged_lines", "order_id", "product_id", "product_id IS NULL")]
for t, key, columns in [("staged_comments", "id", {"content": (2, 1000)}), ("new_blogs", "seq", {"title": (3, 255)}),
                        ("blog_changes", "seq", {"title": (3, 255)}),
                        ("new_addresses", "seq", {"address": (0, 500), "city": (0, 100), "province": (0, 100),
                                                  "postal_code": (0, 20)}),
                        ("new_categories", "seq", {"fa_name": (3, 255), "en_name": (3, 255)}),
                        ("category_changes", "seq", {"fa_name": (3, 255), "en_name": (3, 255)})]:
    for col, (lo, hi) in columns.items():
        _PAY.append(_violation("length", t, key, col, f"length({col}) NOT BETWEEN {lo} AND {hi}"))
        if t not in ("blog_changes", "category_changes"):
            _PAY.append(_violation("required", t, key, col, f"{col} IS NULL"))
_PAY.append(_violation("required", "new_blogs", "seq", "content", "content IS NULL"))
sql("validate_change_payloads", W("staged_comments new_blogs staged_lines new_addresses new_categories category_changes "
                                  "blog_changes") + "\nUNION ALL ".join(_PAY))
sql("validate_profile_patches", W("staged_users", """profile_patches AS (
  SELECT id, first_name, last_name, email, phone_number, '021' || lpad(CAST(id AS VARCHAR), 7, '0') AS home_phone_number
  FROM staged_users)""") + "\nUNION ALL ".join([
    _violation("length", "profile_patches", "id", "first_name", "length(first_name) NOT BETWEEN 2 AND 50"),
    _violation("length", "profile_patches", "id", "last_name", "length(last_name) NOT BETWEEN 2 AND 50"),
    _violation("mobile", "profile_patches", "id", "phone_number", "NOT regexp_full_match(phone_number, '09[0-9]{9}')"),
    _violation("email", "profile_patches", "id", "email", "NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')"),
    _violation("landline", "profile_patches", "id", "home_phone_number",
               "NOT regexp_full_match(home_phone_number, '0[0-9]{10}') AND home_phone_number <> ''")]))

sql("audit_stock", W("cart_items products") + """
SELECT 'stock' AS rule, 'cart_items' AS "table", CAST(ci.cart_id AS VARCHAR) || '|' || CAST(ci.product_id AS VARCHAR) AS key,
  'quantity' AS "column", CAST(ci.quantity AS VARCHAR) || '>' || CAST(p.stock AS VARCHAR) AS value
FROM cart_items ci JOIN products p ON ci.product_id = p.id WHERE p.stock < ci.quantity""")

sql("audit_flags", W("product_images staged_images addresses address_requests", *_CHOSEN) + """
SELECT 'one_flag' AS rule, 'product_images' AS "table", CAST(product_id AS VARCHAR) AS key, 'is_main' AS "column",
  CAST(n AS VARCHAR) AS value
FROM (SELECT product_id, SUM(CAST(is_main AS INT)) n FROM product_images GROUP BY product_id) WHERE n > 1
UNION ALL SELECT 'one_flag', 'staged_images', CAST(product_id AS VARCHAR), 'is_main', CAST(n AS VARCHAR)
FROM (SELECT product_id, SUM(CAST(is_main AS INT)) n FROM staged_images GROUP BY product_id) WHERE n > 1
UNION ALL SELECT 'one_flag', 'addresses', CAST(user_id AS VARCHAR), 'is_default', CAST(n AS VARCHAR)
FROM (SELECT user_id, SUM(CAST(is_default AS INT)) n FROM addresses GROUP BY user_id) WHERE n > 1
UNION ALL SELECT 'one_flag', 'addresses_after_requests', CAST(user_id AS VARCHAR), 'is_default', CAST(n AS VARCHAR)
FROM (SELECT user_id, SUM(CAST(is_default AS INT)) n FROM after GROUP BY user_id) WHERE n > 1""")

sql("validate_uploads", W("uploads") + """
SELECT 'allowed' AS rule, 'uploads' AS "table", CAST(upload_id AS VARCHAR) AS key, 'mimetype' AS "column",
  mimetype AS value FROM uploads WHERE mimetype NOT IN ('image/jpeg', 'image/png', 'image/webp')
UNION ALL SELECT 'range', 'uploads', CAST(upload_id AS VARCHAR), 'size', CAST(size AS VARCHAR)
  FROM uploads WHERE size > 5242880
UNION ALL SELECT 'file_type', 'uploads', CAST(upload_id AS VARCHAR), 'filename', filename FROM uploads
  WHERE NOT (regexp_matches(lower(regexp_extract(filename, '(\\.[^./\\\\]+)$', 1)), 'jpeg|jpg|png')
             AND regexp_matches(mimetype, 'jpeg|jpg|png'))
UNION ALL SELECT 'transport_size', 'uploads', CAST(upload_id AS VARCHAR), 'size', CAST(size AS VARCHAR)
  FROM uploads WHERE size > 10485760
UNION ALL SELECT 'file_count', 'uploads', CAST(product_id AS VARCHAR), 'files', CAST(n AS VARCHAR)
  FROM (SELECT product_id, COUNT(*) n FROM uploads GROUP BY product_id) WHERE n < 1 OR n > 5""")
