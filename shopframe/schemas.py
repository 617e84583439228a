"""Declared table schemas, enum domains and the foreign-key graph.

Keys are typed ``string`` as in the source model; operators never depend on
the key type, so tables landed with ``bigint`` keys work unchanged.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
TS = T.TimestampType()
RATING = T.DecimalType(3, 2)
MONEY = T.DecimalType(12, 2)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TABLES: dict[str, T.StructType] = {
    "users": _schema(
        ("id", S, False), ("first_name", S, False), ("last_name", S, False),
        ("email", S, False), ("phone_number", S, False), ("home_address", S, True),
        ("home_phone_number", S, True), ("password_hash", S, False), ("role", S, False),
        ("profile_image_url", S, True), ("is_verified", B, True), ("verified_at", TS, True),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "sellers": _schema(
        ("id", S, False), ("user_id", S, True), ("shop_name", S, False), ("rating", RATING, True),
        ("status", S, True), ("created_at", TS, True), ("updated_at", TS, True)),
    "categories": _schema(
        ("id", S, False), ("fa_name", S, False), ("en_name", S, False),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "products": _schema(
        ("id", S, False), ("seller_id", S, True), ("name", S, False), ("price", L, False),
        ("description", S, True), ("stock", I, False), ("status", S, True),
        ("created_at", TS, True), ("updated_at", TS, True), ("average_rating", RATING, True)),
    "product_images": _schema(
        ("id", S, False), ("product_id", S, True), ("image_url", S, False), ("is_main", B, True),
        ("created_at", TS, True)),
    "product_features": _schema(
        ("id", S, False), ("product_id", S, True), ("name", S, False), ("value", S, False),
        ("created_at", TS, True)),
    "carts": _schema(("id", S, False), ("user_id", S, True), ("created_at", TS, True),
                     ("updated_at", TS, True)),
    "cart_items": _schema(
        ("id", S, False), ("cart_id", S, True), ("product_id", S, True), ("quantity", I, False),
        ("price", L, False), ("created_at", TS, True)),
    "blogs": _schema(
        ("id", S, False), ("author_id", S, True), ("title", S, False), ("en_title", S, False),
        ("content", S, False), ("views", I, True), ("created_at", TS, True), ("updated_at", TS, True),
        ("average_rating", RATING, True)),
    "comments": _schema(
        ("id", S, False), ("user_id", S, True), ("parent_type", S, False), ("parent_id", S, False),
        ("content", S, False), ("rating", I, False), ("status", S, True),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "email_verifications": _schema(
        ("id", S, False), ("user_id", S, True), ("verification_code", S, False),
        ("expires_at", TS, False), ("created_at", TS, True), ("attempts", I, True)),
    "product_categories": _schema(
        ("id", S, False), ("product_id", S, True), ("category_id", S, True), ("created_at", TS, True)),
    "addresses": _schema(
        ("id", S, False), ("user_id", S, True), ("address", S, False), ("city", S, False),
        ("province", S, False), ("postal_code", S, False), ("is_default", B, True),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "orders": _schema(
        ("id", S, False), ("user_id", S, True), ("address_id", S, True), ("total_amount", MONEY, False),
        ("status", S, True), ("payment_method", S, True), ("created_at", TS, True),
        ("updated_at", TS, True)),
    "order_items": _schema(
        ("id", S, False), ("order_id", S, True), ("product_id", S, True), ("quantity", I, False),
        ("price_at_time", MONEY, False), ("created_at", TS, True)),
    "refresh_tokens": _schema(
        ("id", L, False), ("user_id", S, False), ("token", S, False), ("expires_at", TS, False),
        ("is_revoked", B, True), ("created_at", TS, True)),
}

# Enum domains in declaration order (declaration order is the
# sort order of the source database, so ranks follow list position).
ENUMS: dict[str, list[str]] = {
    "user_role": ["admin", "seller", "customer"],
    "seller_status": ["active", "pending", "suspended"],
    "product_status": ["active", "inactive", "out_of_stock"],
    "comment_status": ["pending", "approved", "rejected"],
    "comment_parent_type": ["blog", "product"],
    "order_status": ["pending", "processing", "shipped", "delivered", "cancelled"],
}

# (table, column) -> enum name
ENUM_COLUMNS: dict[tuple[str, str], str] = {
    ("users", "role"): "user_role",
    ("sellers", "status"): "seller_status",
    ("products", "status"): "product_status",
    ("comments", "status"): "comment_status",
    ("comments", "parent_type"): "comment_parent_type",
    ("orders", "status"): "order_status",
}

# Defaults applied on insert.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "customer", "is_verified": False},
    "sellers": {"rating": 0.0, "status": "pending"},
    "products": {"stock": 0, "status": "active", "average_rating": 0.0},
    "product_images": {"is_main": False},
    "cart_items": {"quantity": 1},
    "blogs": {"views": 0, "average_rating": 0.0},
    "comments": {"status": "pending"},
    "email_verifications": {"attempts": 0},
    "addresses": {"is_default": False},
    "orders": {"status": "pending"},
    "refresh_tokens": {"is_revoked": False},
}

# Foreign keys as (child, fk column, parent, on_delete).
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("sellers", "user_id", "users", "cascade"),
    ("products", "seller_id", "sellers", "cascade"),
    ("product_images", "product_id", "products", "cascade"),
    ("product_features", "product_id", "products", "cascade"),
    ("carts", "user_id", "users", "cascade"),
    ("cart_items", "cart_id", "carts", "cascade"),
    ("cart_items", "product_id", "products", "cascade"),
    ("blogs", "author_id", "users", "set_null"),
    ("comments", "user_id", "users", "set_null"),
    ("email_verifications", "user_id", "users", "cascade"),
    ("product_categories", "product_id", "products", "cascade"),
    ("product_categories", "category_id", "categories", "cascade"),
    ("addresses", "user_id", "users", "cascade"),
    ("orders", "user_id", "users", "restrict"),
    ("orders", "address_id", "addresses", "restrict"),
    ("order_items", "order_id", "orders", "cascade"),
    ("order_items", "product_id", "products", "restrict"),
    ("refresh_tokens", "user_id", "users", "cascade"),
]

# Unique keys (single columns and pairs).
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "users": [("id",), ("email",), ("phone_number",)],
    "sellers": [("id",), ("shop_name",)],
    "categories": [("id",), ("fa_name", "en_name")],
    "product_categories": [("product_id", "category_id")],
    "refresh_tokens": [("id",), ("token",)],
}

# NOT NULL columns checked by the audit.
NOT_NULL: dict[str, list[str]] = {
    "users": ["first_name", "last_name", "email", "phone_number", "role"],
    "sellers": ["shop_name"],
    "categories": ["fa_name", "en_name"],
    "products": ["name", "price", "stock"],
    "product_images": ["image_url"],
    "product_features": ["name", "value"],
    "cart_items": ["quantity", "price"],
    "blogs": ["title", "content"],
    "comments": ["parent_type", "parent_id", "content", "rating"],
    "email_verifications": ["verification_code", "expires_at"],
    "addresses": ["address", "city", "province", "postal_code"],
    "orders": ["total_amount"],
    "order_items": ["quantity", "price_at_time"],
    "refresh_tokens": ["user_id", "token", "expires_at"],
}
