"""Marketplace tables derived from the supplied TPC-H-style test tables.

These are test inputs, not operators: each definition only reshapes a raw
table into the schema the operators expect. The same SQL text is rendered
for Spark (bound to DataFrames, so no global views are needed) and for the
DuckDB oracle (as CTEs over the raw views), so both engines see identical
inputs. ``{name}`` marks a raw table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "labels", "pages"]

# The as-of instant used wherever the source model reads the clock.
AS_OF = "2024-01-20 00:00:00"

DERIVED_SQL: dict[str, str] = {
    "sellers": """
SELECT s_suppkey AS id, s_suppkey AS user_id, s_name AS shop_name,
       CAST(((s_suppkey * 37) % 501) / 100.0 AS DECIMAL(3,2)) AS rating,
       CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'pending' ELSE 'suspended' END AS status,
       DATE '2023-01-01' + CAST(s_suppkey % 500 AS INT) AS created_at
FROM {supplier}""",
    "products": """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % (SELECT COUNT(*) FROM {supplier}) END AS seller_id,
       p_name AS name, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS price,
       p_name || ' ' || p_type || ' ' || p_brand AS description, p_size AS stock,
       CASE p_size % 10 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'inactive' ELSE 'active' END AS status,
       DATE '2022-01-01' + CAST(p_partkey % 700 AS INT) AS created_at
FROM {part}""",
    "categories": """
SELECT DISTINCT c AS id, c AS en_name, lower(c) AS fa_name
FROM (SELECT p_type AS c FROM {part} UNION ALL SELECT p_brand AS c FROM {part}) x""",
    "product_categories": """
SELECT p_partkey AS product_id, p_type AS category_id FROM {part}
UNION ALL SELECT p_partkey, p_brand FROM {part} WHERE p_size > 10""",
    "product_images": """
SELECT page_id AS id, CAST(FLOOR(page_id / 3) AS BIGINT) AS product_id, url AS image_url,
       page_id % 3 = 0 AS is_main
FROM {pages}""",
    "product_features": """
SELECT p_partkey AS product_id, 'brand' AS name, p_brand AS value FROM {part}
UNION ALL SELECT p_partkey, 'type', p_type FROM {part}
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS STRING) FROM {part} WHERE p_size % 2 = 0""",
    "users": """
SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name,
       lower(c_name) || '@example.com' AS email,
       '09' || lpad(CAST(c_custkey AS STRING), 9, '0') AS phone_number,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin'
            WHEN c_custkey < (SELECT COUNT(*) FROM {supplier}) THEN 'seller' ELSE 'customer' END AS role,
       c_acctbal >= 0 AS is_verified,
       DATE '2021-01-01' + CAST(c_custkey % 900 AS INT) AS created_at
FROM {customer}""",
    "addresses": """
SELECT c_custkey AS id, c_custkey AS user_id, c_name AS address, n_name AS city, r_name AS province,
       lpad(CAST(c_nationkey AS STRING), 5, '0') AS postal_code, TRUE AS is_default,
       DATE '2021-01-01' + CAST(c_custkey % 900 AS INT) AS created_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT c_custkey + 1000000, c_custkey, c_name, n_name, r_name,
       lpad(CAST(c_nationkey AS STRING), 5, '0'), FALSE, DATE '2022-01-01' + CAST(c_custkey % 900 AS INT)
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE c_custkey % 3 = 0""",
    "shop_orders": """
SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey AS address_id,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'delivered' END AS status,
       o_orderdate AS created_at
FROM {orders}""",
    "order_items": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
       CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price_at_time
FROM {lineitem}""",
    "carts": """
SELECT MAX(o_orderkey) AS id, o_custkey AS user_id
FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey""",
    "cart_items": """
SELECT l_orderkey AS cart_id, l_partkey AS product_id, MAX(CAST(l_quantity AS INT)) AS quantity,
       CAST(ROUND(MAX(l_extendedprice) * 100) AS BIGINT) AS price, MIN(l_shipdate) AS created_at
FROM {lineitem}
WHERE l_orderkey IN (SELECT MAX(o_orderkey) FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey)
GROUP BY l_orderkey, l_partkey""",
    "comments": """
SELECT event_id AS id, user_id,
       CASE WHEN event_id % 2 = 0 THEN 'product' ELSE 'blog' END AS parent_type,
       CASE WHEN event_id % 2 = 0 THEN event_id % (SELECT COUNT(*) FROM {part})
            ELSE event_id % (SELECT COUNT(*) FROM {documents}) END AS parent_id,
       event_type || ' ' || props AS content, CAST(1 + (event_id * 7 + user_id) % 5 AS INT) AS rating,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'approved'
            WHEN event_type = 'error' THEN 'rejected' ELSE 'pending' END AS status,
       ts AS created_at
FROM {events}""",
    "blogs": """
SELECT doc_id AS id, doc_id % (SELECT COUNT(*) FROM {customer}) AS author_id, split_part(text, chr(10), 1) AS title,
       text AS content, lang AS category, n_chars AS views,
       DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS created_at
FROM {documents}""",
    "blog_tags": """
SELECT doc_id AS blog_id, 'quality' AS name FROM {labels} WHERE quality = 1
UNION ALL SELECT doc_id, 'toxic' FROM {labels} WHERE toxic = 1""",
    "email_verifications": """
SELECT event_id AS id, user_id, lpad(CAST(event_id % 1000000 AS STRING), 6, '0') AS verification_code,
       ts + INTERVAL 15 MINUTE AS expires_at, ts AS created_at, CAST(event_id % 7 AS INT) AS attempts
FROM {events} WHERE event_type IN ('signup', 'error')""",
    "refresh_tokens": """
SELECT event_id AS id, user_id, 'tok' || CAST(event_id AS STRING) AS token,
       ts + INTERVAL 7 DAY AS expires_at, event_id % 4 = 0 AS is_revoked, ts AS created_at
FROM {events} WHERE event_type = 'view'""",
}

# Stand-in change and request frames (FIXTURES §3). Each only reshapes rows
# of the test tables into the schema a change operator expects; ``{name}``
# may name a raw or a derived table. Every frame carries (change_ts, seq)
# where order matters.
CHANGE_SQL: dict[str, str] = {
    "code_submissions": """
SELECT user_id, verification_code AS code, created_at + INTERVAL 1 MINUTE * CAST(id % 20 AS INT) AS submitted_at
FROM {email_verifications}""",
    "presented_tokens": """
SELECT 'tok' || CAST(CASE WHEN event_type = 'click' THEN event_id - 1 ELSE event_id END AS STRING) AS token,
       ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type IN ('view', 'click')""",
    "address_requests": """
SELECT user_id, CASE WHEN event_id % 2 = 0 THEN user_id + 1000000 ELSE user_id END AS id,
       ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type = 'click'""",
    "deleted_images": """
SELECT id FROM {product_images} WHERE image_url LIKE '%/fr/%'""",
    "image_uploads": """
SELECT CAST(FLOOR(page_id / 2) AS BIGINT) AS product_id, '/uploads/' || CAST(page_id AS STRING) AS image_url,
       CAST(DATE '2024-01-20' AS TIMESTAMP) AS change_ts, 0 - page_id AS seq
FROM {pages}""",
    "user_changes": """
SELECT user_id AS id, CASE WHEN event_id % 2 = 0 THEN upper(props) END AS first_name,
       CASE WHEN value > 50 THEN event_type || CAST(event_id AS STRING) END AS last_name,
       ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type = 'click'""",
    "product_patches": """
SELECT event_id % (SELECT COUNT(*) FROM {part}) AS id,
       CASE event_id % 3 WHEN 0 THEN split('name,stock', ',') WHEN 1 THEN split('description', ',')
            ELSE split('stock,status', ',') END AS present,
       props AS name, CAST(NULL AS STRING) AS description, CAST(FLOOR(value) AS INT) AS stock,
       CASE WHEN value > 50 THEN 'inactive' ELSE 'active' END AS status, ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type = 'view'""",
    "cart_changes": """
SELECT user_id, event_id % (SELECT COUNT(*) FROM {part}) AS product_id,
       CAST(1 + FLOOR(value) % 60 AS INT) AS quantity, ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type = 'purchase'""",
    "cart_clear_requests": """
SELECT DISTINCT user_id FROM {events} WHERE event_type = 'error'""",
    "cart_quantity_changes": """
SELECT c.user_id + CASE WHEN ci.product_id % 5 = 0 THEN 1 ELSE 0 END AS user_id, ci.cart_id, ci.product_id,
       ci.quantity + 10 AS quantity, ci.created_at AS change_ts, ci.product_id AS seq
FROM {cart_items} ci JOIN {carts} c ON ci.cart_id = c.id""",
    "feature_replacements": """
SELECT p_partkey AS product_id, 'material' AS name, p_type AS value FROM {part} WHERE p_size > 40
UNION ALL SELECT p_partkey, 'label', p_name FROM {part} WHERE p_size > 45""",
    "emptied_feature_parents": """
SELECT p_partkey AS product_id FROM {part} WHERE p_size = 1""",
    "product_delete_requests": """
SELECT user_id AS requester_id, event_id % (SELECT COUNT(*) FROM {part}) AS id
FROM {events} WHERE event_type = 'error'""",
    "order_status_changes": """
SELECT oi.order_id, p.seller_id + CASE WHEN oi.line_no = 1 THEN 0 ELSE 1 END AS seller_user_id,
       CASE oi.line_no WHEN 1 THEN 'shipped' WHEN 2 THEN 'canceled' WHEN 3 THEN 'bogus' ELSE 'delivered' END AS status,
       TIMESTAMP '2024-01-20 00:00:00' AS change_ts, CAST(oi.line_no AS BIGINT) AS seq
FROM {order_items} oi JOIN {products} p ON oi.product_id = p.id""",
    "comment_moderation": """
SELECT event_id AS comment_id, CASE WHEN value > 50 THEN 'approved' ELSE 'rejected' END AS status,
       ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type = 'view'""",
    "seller_requests": """
SELECT id AS user_id, 'Shop#' || CAST(id % 40 AS STRING) AS shop_name, CAST(created_at AS TIMESTAMP) AS change_ts,
       id AS seq
FROM {users} WHERE first_name = 'BUILDING'""",
    "registrations": """
SELECT c_custkey AS request_id, c_mktsegment AS first_name, c_name AS last_name,
       CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) || '@example.com'
            ELSE lower(c_name) || '@new.example.org' END AS email,
       CASE WHEN c_custkey % 3 = 0 THEN '09' || lpad(CAST(c_custkey + 1 AS STRING), 9, '0')
            ELSE '091' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS phone_number,
       CASE WHEN c_custkey % 2 = 0 THEN 'Passw0rd' || CAST(c_custkey AS STRING) ELSE 'password' END AS password
FROM {customer}""",
    "profile_changes": """
SELECT u.id, CASE WHEN u.id % 2 = 0 THEN n.email ELSE 'new' || u.email END AS email,
       CAST(NULL AS STRING) AS phone_number, 'Name' || CAST(u.id AS STRING) AS first_name,
       CAST(NULL AS STRING) AS last_name, CAST(u.created_at AS TIMESTAMP) AS change_ts, u.id AS seq
FROM {users} u LEFT JOIN {users} n ON n.id = u.id + 1""",
    "uploads": """
SELECT page_id AS upload_id, CAST(FLOOR(page_id / 3) AS BIGINT) AS product_id,
       'img' || CAST(page_id AS STRING) || CASE WHEN url LIKE '%/en/%' THEN '.png' WHEN url LIKE '%/fr/%' THEN '.gif'
            ELSE '.JPG' END AS filename,
       CASE WHEN url LIKE '%/en/%' THEN 'image/png' WHEN url LIKE '%/fr/%' THEN 'image/gif' ELSE 'image/jpeg' END
         AS mimetype,
       length(html) * 1000 AS size
FROM {pages}""",
    "seller_renames": """
SELECT s.id, CASE WHEN s.id % 4 = 0 THEN n.shop_name ELSE s.shop_name || ' Store' END AS shop_name,
       CAST(s.created_at AS TIMESTAMP) AS change_ts, s.id AS seq
FROM {sellers} s LEFT JOIN {sellers} n ON n.id = s.id + 1""",
    "new_categories": """
SELECT lower(c) AS fa_name, upper(c) AS en_name, TIMESTAMP '2024-01-20 00:00:00' AS change_ts, CAST(k AS BIGINT) AS seq
FROM (SELECT p_name AS c, p_partkey AS k FROM {part} WHERE p_size > 45
      UNION ALL SELECT c_mktsegment, c_custkey + 1000000 FROM {customer}) x
UNION ALL SELECT fa_name, en_name, TIMESTAMP '2024-01-20 00:00:00', 0 - CAST(length(en_name) AS BIGINT)
FROM {categories} WHERE en_name LIKE 'Brand#1%'""",
    "new_comments": """
SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'product' ELSE 'blog' END AS parent_type,
       event_id % 2500 AS parent_id, props AS content, CAST(1 + event_id % 7 AS INT) AS rating,
       ts AS change_ts, event_id AS seq
FROM {events} WHERE event_type = 'click'""",
    "new_addresses": """
SELECT c_custkey AS user_id, 'Second ' || c_name AS address, n_name AS city, r_name AS province,
       lpad(CAST(c_nationkey AS STRING), 5, '0') AS postal_code, c_custkey % 2 = 0 AS is_default,
       TIMESTAMP '2024-01-20 00:00:00' AS change_ts, c_custkey AS seq
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE c_mktsegment = 'MACHINERY'""",
    "product_update_patches": """
SELECT p.id, CASE WHEN e.event_id % 2 = 0 THEN p.seller_id ELSE e.user_id END AS requester_id,
       u.role = 'admin' AS is_admin,
       CASE e.event_id % 3 WHEN 0 THEN split('name,price', ',') WHEN 1 THEN split('stock', ',')
            ELSE split('status,description', ',') END AS present,
       e.props AS name, CAST(FLOOR(e.value * 100) AS BIGINT) AS price, CAST(NULL AS STRING) AS description,
       CAST(FLOOR(e.value) AS INT) AS stock, 'inactive' AS status, e.ts AS change_ts, e.event_id AS seq
FROM {events} e JOIN {products} p ON p.id = e.event_id % (SELECT COUNT(*) FROM {part})
LEFT JOIN {users} u ON u.id = CASE WHEN e.event_id % 2 = 0 THEN p.seller_id ELSE e.user_id END
WHERE e.event_type = 'click'""",
    "product_update_categories": """
SELECT id AS product_id, change_ts, seq, CASE WHEN stock > 95 THEN NULL ELSE 'LARGE' END AS category_id
FROM {product_update_patches} WHERE price > 9000
UNION ALL SELECT id, change_ts, seq, 'Brand#4' FROM {product_update_patches} WHERE price > 9000 AND stock <= 95""",
    "product_update_features": """
SELECT id AS product_id, change_ts, seq, 'color' AS name, name AS value
FROM {product_update_patches} WHERE price < 1000""",
    "product_delete_batch": """
SELECT CASE WHEN e.event_id % 2 = 0 THEN p.seller_id ELSE e.user_id END AS requester_id, p.id
FROM {events} e JOIN {products} p ON p.id = e.event_id % (SELECT COUNT(*) FROM {part})
WHERE e.event_type = 'error'""",
    "address_changes": """
SELECT CASE WHEN e.event_id % 2 = 0 THEN e.user_id + 1000000 ELSE e.user_id END AS id,
       CASE WHEN e.event_id % 5 = 0 THEN e.user_id + 1 ELSE e.user_id END AS user_id,
       CASE WHEN e.value > 50 THEN 'Moved ' || CAST(e.event_id AS STRING) END AS address,
       CASE WHEN e.event_type = 'view' THEN 'Tehran' END AS city,
       e.value > 80 AS is_default, e.ts AS change_ts, e.event_id AS seq
FROM {events} e WHERE e.event_type IN ('view', 'purchase')""",
    "owned_uploads": """
SELECT CAST(FLOOR(page_id / 2) AS BIGINT) AS product_id, '/uploads/' || CAST(page_id AS STRING) AS image_url,
       CAST(DATE '2024-01-20' AS TIMESTAMP) AS change_ts, 0 - page_id AS seq,
       CASE WHEN page_id % 3 = 0 THEN 0 - 1 ELSE CAST(FLOOR(page_id / 2) AS BIGINT) % (SELECT COUNT(*) FROM {supplier}) END
         AS requester_id
FROM {pages}""",
    "comment_deletions": """
SELECT e.user_id AS requester_id, e.event_id - 1 AS id, u.role = 'admin' AS is_admin
FROM {events} e LEFT JOIN {users} u ON u.id = e.user_id WHERE e.event_type = 'error'""",
    "cart_removals": """
SELECT c.user_id + CASE WHEN ci.product_id % 3 = 0 THEN 1 ELSE 0 END AS user_id, ci.cart_id, ci.product_id
FROM {cart_items} ci JOIN {carts} c ON ci.cart_id = c.id WHERE ci.quantity > 25""",
    "new_blogs": """
SELECT doc_id % 1000 AS author_id, split_part(text, chr(10), 1) AS title, text AS content,
       CASE WHEN lang = 'en' THEN upper(split_part(text, chr(10), 1)) END AS en_title,
       TIMESTAMP '2024-01-20 00:00:00' AS change_ts, doc_id AS seq
FROM {documents}""",
    "blog_changes": """
SELECT doc_id * 2 AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Title ' || CAST(doc_id AS STRING) END AS title,
       CASE WHEN doc_id % 5 = 0 THEN source END AS content, TIMESTAMP '2024-01-20 00:00:00' AS change_ts, doc_id AS seq
FROM {documents}""",
    "category_changes": """
SELECT id, CASE WHEN length(en_name) % 2 = 0 THEN 'new ' || fa_name END AS fa_name, 'New ' || en_name AS en_name,
       TIMESTAMP '2024-01-20 00:00:00' AS change_ts, CAST(length(en_name) AS BIGINT) AS seq
FROM {categories}
UNION ALL SELECT 'none ' || en_name, fa_name, en_name, TIMESTAMP '2024-01-20 00:00:00', CAST(length(en_name) AS BIGINT)
FROM {categories}""",
    "address_deletions": """
SELECT id, CASE WHEN id % 4 = 0 THEN user_id + 1 WHEN id % 4 = 1 THEN NULL ELSE user_id END AS requester_id
FROM {addresses} WHERE NOT is_default""",
    # rows as they come from outside, with faults of every kind, for the audits
    "staged_users": """
SELECT c_custkey AS id, NULLIF(c_mktsegment, 'BUILDING') AS first_name, c_name AS last_name,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE lower(c_name) END AS email, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '09' || CAST(c_custkey AS STRING) END AS phone_number,
       CASE WHEN c_nationkey = 3 THEN 'owner' WHEN c_nationkey = 4 THEN NULL ELSE 'customer' END AS role
FROM {customer}""",
    "staged_comments": """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN user_id + 1000000000 ELSE user_id END AS user_id,
       CASE event_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'blog' ELSE 'product' END AS parent_type,
       event_id % (2 * (SELECT COUNT(*) FROM {part})) AS parent_id,
       substr(props, 1, CAST(event_id % 4 AS INT)) AS content, CAST(event_id % 8 AS INT) AS rating,
       CASE WHEN event_type = 'view' THEN 'approved' ELSE event_type END AS status
FROM {events}""",
    "staged_lines": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey * 2 AS product_id,
       CAST(l_quantity AS INT) - 3 AS quantity,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price_at_time
FROM {lineitem}""",
    "staged_images": """
SELECT page_id AS id, CAST(FLOOR(page_id / 4) AS BIGINT) AS product_id, url AS image_url, page_id % 3 <> 0 AS is_main
FROM {pages}""",
}
DERIVED_SQL.update(CHANGE_SQL)

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def raw_names(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(DERIVED_SQL[name])))


def dependency_order(names) -> list[str]:
    """Derived names plus the derived tables they read, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out or n not in DERIVED_SQL:
            return
        for dep in raw_names(n):
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Marketplace:
    """Lazily derived marketplace tables for one test-data directory.

    With ``landed`` (a folder written by ``land``) the derived tables are
    read back as plain parquet tables, as in production where they are
    landed once and scanned by every report.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, landed: str | None = None):
        self.spark, self.sf_dir, self.landed = spark, sf_dir, landed
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if self.landed and name in DERIVED_SQL:
                table = BUCKETED.get((self.landed, name))
                self._cache[name] = (self.spark.table(table) if table else
                                     self.spark.read.parquet(f"{self.landed.rstrip('/')}/{name}"))
                return self._cache[name]
            sql = DERIVED_SQL[name]
            frames = {r: (self[r] if r in DERIVED_SQL else self.raw(r)) for r in raw_names(name)}
            self._cache[name] = self.spark.sql(sql, **frames)
        return self._cache[name]

    def __contains__(self, name: str) -> bool:
        return name in DERIVED_SQL or name in self._cache

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._cache[name] = df

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED_SQL:
            return self[name]
        raise AttributeError(name)


# sf_dir -> folder of landed derived tables (set by ``land``).
LANDED: dict[str, str] = {}
# (landed folder, table) -> catalog table name of a bucketed landing.
BUCKETED: dict[tuple[str, str], str] = {}


def marketplace(spark: SparkSession, sf_dir: str) -> Marketplace:
    return Marketplace(spark, sf_dir, LANDED.get(sf_dir.rstrip("/")))


def land(spark: SparkSession, sf_dir: str, dest: str, names=None,
         buckets: dict[str, tuple[str, int]] | None = None) -> str:
    """Write every derived table of ``sf_dir`` as parquet under ``dest`` and
    make later ``marketplace(spark, sf_dir)`` calls read them from there.

    ``buckets`` maps a table to (key, bucket count): those are landed as
    bucketed tables (``sources.tables.save_bucketed``) so joins on the key
    between tables with the same bucket count need no exchange.
    """
    from .tables import save_bucketed
    import re as _re
    src = Marketplace(spark, sf_dir)
    tag = _re.sub(r"\W", "_", dest.rstrip("/").rsplit("/", 1)[-1])
    for n in (names or list(DERIVED_SQL)):
        path = f"{dest.rstrip('/')}/{n}"
        if buckets and n in buckets:
            key, count = buckets[n]
            table = f"landed_{tag}_{n}"
            save_bucketed(src[n], table, path, key, count)
            BUCKETED[(dest, n)] = table
        else:
            src[n].write.mode("overwrite").parquet(path)
    LANDED[sf_dir.rstrip("/")] = dest
    return dest


def duckdb_with(*names: str) -> str:
    """``WITH`` clause defining the named derived tables over raw DuckDB views."""
    parts = []
    for n in names:
        body = _PLACEHOLDER.sub(lambda m: m.group(1), DERIVED_SQL[n]).strip()
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
