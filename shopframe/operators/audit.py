"""Integrity and payload audits.

Every audit returns rows of the shape
``violations(rule, table, key, column, value)``; an empty result means
clean. All violations are reported, not just the first. Audits are plain
filters, anti joins and grouped counts, so they scale with the tables.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENUMS
from .dealing import key_join, row_counts

VIOLATION_COLS = ["rule", "table", "key", "column", "value"]


def _v(df: DataFrame, rule: str, table: str, key: str | Column, column: str, value: Column) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), k.cast("string").alias("key"),
                     F.lit(column).alias("column"), value.cast("string").alias("value"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- C1
def unique_key(df: DataFrame, table: str, cols: Sequence[str], key: str = "id") -> DataFrame:
    """Rows whose (cols) value occurs more than once (nulls never clash)."""
    cols = list(cols)
    dup = df.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    counts = dup.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    hits = dup.join(counts.drop("__n"), cols, "left_semi")
    k = key if key in df.columns else F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return _v(hits, "unique", table, k, ",".join(cols), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


# ---------------------------------------------------------------- C2 / J8
def orphans(child: DataFrame, table: str, fk: str, parent: DataFrame, parent_key: str = "id",
            key: str = "id", counts: tuple[int, int] | None = None) -> DataFrame:
    """Child rows whose non-null foreign key has no parent (anti join). ``counts`` are the rows of child and
    parent, where they are known; they bound what one task joins."""
    p = parent.select(F.col(parent_key).alias("__pk"))
    n_child, n_parent = counts or row_counts([child, parent])
    hit = key_join(child.where(F.col(fk).isNotNull()), p, fk, "__pk", "left_anti", n_child, n_parent)
    k = key if key in child.columns else F.col(fk)
    return _v(hit, "foreign_key", table, k, fk, F.col(fk))


def polymorphic_orphans(comments: DataFrame, parents: dict[str, tuple[DataFrame, str]],
                        type_col: str = "parent_type", id_col: str = "parent_id") -> DataFrame:
    """Comments whose parent of the named type does not exist (two typed anti joins)."""
    parts = []
    for tval, (table, pkey) in sorted(parents.items()):
        p = table.select(F.col(pkey).alias("__pk"))
        hit = comments.where(F.col(type_col) == tval).join(p, F.col(id_col) == p["__pk"], "left_anti")
        parts.append(_v(hit, "parent_exists", "comments", "id", f"{type_col}:{tval}", F.col(id_col)))
    return union_all(parts)


# ---------------------------------------------------------------- C8 / C13
def stock_cover(cart_items: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines asking for more than the product's stock."""
    p = products.select(F.col("id").alias("__pid"), F.col("stock").alias("__stock"))
    hit = cart_items.join(p, cart_items["product_id"] == p["__pid"], "inner").where(F.col("__stock") < F.col("quantity"))
    key = F.concat_ws("|", F.col("cart_id").cast("string"), F.col("product_id").cast("string"))
    return _v(hit, "stock", "cart_items", key, "quantity",
              F.concat_ws(">", F.col("quantity").cast("string"), F.col("__stock").cast("string")))


def at_most_one_flag(df: DataFrame, table: str, owner: str, flag: str) -> DataFrame:
    """Owners with more than one flagged row (sum of flags > 1)."""
    g = df.groupBy(owner).agg(F.sum(F.col(flag).cast("int")).alias("__n")).where(F.col("__n") > 1)
    return _v(g, "one_flag", table, owner, flag, F.col("__n"))


# ---------------------------------------------------------------- C9 .. C12, C14 payload rules
# Payload patterns of the source's validation rules.
MOBILE_PATTERN = r"^09[0-9]{9}$"
LANDLINE_PATTERN = r"^0[0-9]{10}$"
PASSWORD_PATTERN = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d)[a-zA-Z\d]{8,}$"
# Ours: a plain local@domain.tld check standing in for the source's library
# e-mail validator (which also checks TLD lists); stricter rules can be added.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
IMAGE_MIME_TYPES = ["image/jpeg", "image/png", "image/webp"]
MAX_IMAGE_BYTES = 5 * 1024 * 1024
MAX_IMAGES_PER_PRODUCT = 5
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
UPLOAD_TYPE_PATTERN = "jpeg|jpg|png"
PAYMENT_METHODS = ["credit_card", "bank_transfer"]


class Rule:
    """One named rule: a column expression that is true when a row *violates* it."""

    def __init__(self, name: str, column: str, violated: Column, value: Column | None = None):
        self.name, self.column, self.violated = name, column, violated
        self.value = value if value is not None else F.col(column).cast("string")


def pattern_rule(column: str, pattern: str, name: str = "pattern", allow_empty: bool = False) -> Rule:
    c = F.col(column)
    ok = c.rlike(pattern)
    if allow_empty:
        ok = ok | (c == "")
    return Rule(name, column, c.isNotNull() & ~ok)


def required_rule(column: str) -> Rule:
    return Rule("required", column, F.col(column).isNull())


def length_rule(column: str, min_len: int | None = None, max_len: int | None = None) -> Rule:
    n = F.length(F.col(column))
    bad = F.lit(False)
    if min_len is not None:
        bad = bad | (n < min_len)
    if max_len is not None:
        bad = bad | (n > max_len)
    return Rule("length", column, F.col(column).isNotNull() & bad)


def allowed_rule(column: str, values: Sequence[str]) -> Rule:
    return Rule("allowed", column, F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def range_rule(column: str, low=None, high=None, low_exclusive: bool = False) -> Rule:
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | ((c <= F.lit(low)) if low_exclusive else (c < F.lit(low)))
    if high is not None:
        bad = bad | (c > F.lit(high))
    return Rule("range", column, c.isNotNull() & bad)


def not_null_rule(column: str) -> Rule:
    """C4."""
    return Rule("not_null", column, F.col(column).isNull())


def enum_rule(column: str, domain: Sequence[str]) -> Rule:
    """Non-null values outside the declared domain."""
    return Rule("enum", column, F.col(column).isNotNull() & ~F.col(column).isin(list(domain)))


def domain_rules(table: str) -> list[Rule]:
    """The declared domains of a stored table, to be run in one pass by ``validate``."""
    enums = {"users": {"role": "user_role"}, "sellers": {"status": "seller_status"},
             "products": {"status": "product_status"}, "shop_orders": {"status": "order_status"},
             "comments": {"status": "comment_status", "parent_type": "comment_parent_type"}}
    rules = [not_null_rule(c) for c in {"users": ["first_name", "last_name", "email", "phone_number", "role"]}.get(table, [])]
    rules += [enum_rule(c, ENUMS[e]) for c, e in enums.get(table, {}).items()]
    return rules + {
        "comments": [range_rule("rating", 1, 5), length_rule("content", 2, 1000)],
        "products": [range_rule("price", 0, None, low_exclusive=True), range_rule("stock", 0, None)],
        "cart_items": [range_rule("quantity", 1, None)],
        "order_items": [range_rule("quantity", 1, None), range_rule("price_at_time", 0, None, low_exclusive=True)],
        "sellers": [length_rule("shop_name", 3, 255)], "blogs": [length_rule("title", 3, 255)],
        "categories": [length_rule("en_name", 3, 255)],
    }.get(table, [])


def array_size_rule(column: str, min_size: int | None = None, max_size: int | None = None) -> Rule:
    n = F.size(F.col(column))
    bad = F.lit(False)
    if min_size is not None:
        bad = bad | (n < min_size)
    if max_size is not None:
        bad = bad | (n > max_size)
    return Rule("array_size", column, F.col(column).isNotNull() & bad, n.cast("string"))


def items_rule(column: str, name: str, bad_item) -> Rule:
    """Some element of an array column violates ``bad_item(x) -> Column``."""
    return Rule(name, column, F.coalesce(F.exists(F.col(column), bad_item), F.lit(False)),
                F.size(F.filter(F.col(column), bad_item)).cast("string"))


def validate(df: DataFrame, rules: Sequence[Rule], key: str, table: str = "payload") -> tuple[DataFrame, DataFrame]:
    """C14: run a rule set over a payload frame.

    Each row gets an array of the rules it breaks (``array_compact`` of
    ``when`` terms, one pass, no join); rows with none are valid, the rest
    are exploded into violation rows. Returns (valid rows, violations).
    """
    checks = F.array_compact(F.array(*[
        F.when(r.violated, F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"),
                                    r.value.alias("value")))
        for r in rules]))
    tagged = df.withColumn("__viol", checks)
    valid = tagged.where(F.size("__viol") == 0).drop("__viol")
    bad = tagged.where(F.size("__viol") > 0).select(F.col(key).cast("string").alias("key"),
                                                     F.explode("__viol").alias("__v"))
    violations = bad.select(F.col("__v.rule").alias("rule"), F.lit(table).alias("table"), "key",
                            F.col("__v.column").alias("column"), F.col("__v.value").alias("value"))
    return valid, violations


def registration_rules() -> list[Rule]:
    """Q36 registration payload."""
    return [required_rule("first_name"), length_rule("first_name", 2, 50),
            required_rule("last_name"), length_rule("last_name", 2, 50),
            required_rule("email"), pattern_rule("email", EMAIL_PATTERN, "email"),
            required_rule("phone_number"), pattern_rule("phone_number", MOBILE_PATTERN, "mobile"),
            required_rule("password"), length_rule("password", 8, 100),
            pattern_rule("password", PASSWORD_PATTERN, "password")]


def user_patch_rules() -> list[Rule]:
    """Q32 profile patch (C7, C9): every field optional; the landline may be empty."""
    return [length_rule("first_name", 2, 50), length_rule("last_name", 2, 50),
            pattern_rule("phone_number", MOBILE_PATTERN, "mobile"), pattern_rule("email", EMAIL_PATTERN, "email"),
            length_rule("home_address", None, 500),
            pattern_rule("home_phone_number", LANDLINE_PATTERN, "landline", allow_empty=True)]


def order_document_rules(uuid_keys: bool = False) -> list[Rule]:
    """Q16 order document (C10, C11); with ``uuid_keys`` the address and every product must be named by a UUID (C9; the
    test tables have bigints)."""
    def no_uuid(x):
        return x["product_id"].isNotNull() & ~x["product_id"].cast("string").rlike(UUID_PATTERN)
    uuids = [pattern_rule("address_id", UUID_PATTERN, "uuid"), items_rule("items", "item_product_uuid", no_uuid)]
    return [*(uuids if uuid_keys else []), required_rule("address_id"), required_rule("payment_method"),
            allowed_rule("payment_method", PAYMENT_METHODS),
            required_rule("items"), array_size_rule("items", 1, None),
            items_rule("items", "item_product", lambda x: x["product_id"].isNull()),
            items_rule("items", "item_quantity", lambda x: x["quantity"].isNull() | (x["quantity"] < 1)),
            items_rule("items", "item_price", lambda x: x["price"].isNull() | (x["price"] <= 0))]


def payload_rules(kind: str, uuid_keys: bool = False) -> list[Rule]:
    """Rules of a create or update payload (C7, C9, C10). An update may leave every field out; with ``uuid_keys`` the
    ids it names must be UUIDs (they are bigints in the test tables)."""
    def text(column, low, high, needed):
        return [*([required_rule(column)] if needed else []), length_rule(column, low, high)]

    def key(column, needed=True):
        uuid = [pattern_rule(column, UUID_PATTERN, "uuid")] if uuid_keys else []
        return [*([required_rule(column)] if needed else []), *uuid]

    name, _, action = kind.partition("_")
    new = action == "create"
    # Limits of the source's payload rules.
    if name == "address":
        return [r for c, n in (("address", 500), ("city", 100), ("province", 100), ("postal_code", 20))
                for r in text(c, None, n, new)]
    if name == "category":
        return [r for c in ("fa_name", "en_name") for r in text(c, 3, 255, new)]
    if name == "seller":
        return [*(key("user_id") if new else []), *text("shop_name", 3, 50 if new else 255, new)]
    if name == "blog":
        return [*text("title", 3, 255, new), *([required_rule("content")] if new else []),
                *(key("author_id", False) if new else [])]
    if name == "comment":
        status = [required_rule("status"), allowed_rule("status", ENUMS["comment_status"])]
        return status if not new else [*text("content", 2, 1000, True), required_rule("rating"), range_rule("rating", 1, 5)]
    if name == "cart":
        return [*(key("product_id") if new else []), required_rule("quantity"), range_rule("quantity", 1, None)]
    if kind == "product_update":
        return [length_rule("name", 1, None), range_rule("price", 0, None, low_exclusive=True),
                array_size_rule("categories", 1, None), range_rule("stock", 0, None),
                allowed_rule("status", ENUMS["product_status"]),
                *([items_rule("categories", "uuid", lambda x: ~x.rlike(UUID_PATTERN))] if uuid_keys else []),
                items_rule("features", "feature", lambda x: x["name"].isNull() | x["value"].isNull())]
    raise ValueError(f"no payload rules for {kind}")


def upload_rules() -> list[Rule]:
    """Q8 per-file rules (C12): payload rule on type and size, plus the
    transport filter (extension and type must name jpeg/jpg/png, 10 MB)."""
    from ..functions.text import file_extension
    ext_ok = file_extension("filename").rlike(UPLOAD_TYPE_PATTERN)
    type_ok = F.col("mimetype").rlike(UPLOAD_TYPE_PATTERN)
    return [allowed_rule("mimetype", IMAGE_MIME_TYPES), range_rule("size", None, MAX_IMAGE_BYTES),
            Rule("file_type", "filename", ~(ext_ok & type_ok)),
            Rule("transport_size", "size", F.col("size") > F.lit(MAX_UPLOAD_BYTES))]


def validate_uploads(uploads: DataFrame, key: str = "upload_id") -> DataFrame:
    """Per-file type/size rules plus 1..5 files per product and request."""
    _, per_file = validate(uploads, upload_rules(), key, "uploads")
    per_req = (uploads.groupBy("product_id").agg(F.count(F.lit(1)).alias("__n"))
                      .where((F.col("__n") < 1) | (F.col("__n") > MAX_IMAGES_PER_PRODUCT)))
    per_req = _v(per_req, "file_count", "uploads", "product_id", "files", F.col("__n"))
    return per_file.unionByName(per_req)
