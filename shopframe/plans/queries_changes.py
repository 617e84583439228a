"""Query registrations for windows, change application and audits.

Change frames come from ``sources.fixtures.CHANGE_SQL``; every operator
runs over whole tables. ``AS_OF`` replaces the source's clock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import find_conflicts, live
from ..operators import audit as C
from ..operators import changes as M
from ..operators import metrics as A
from ..operators import windows as Wn
from ..operators.dealing import deal, row_counts
from ..operators.paging import deep_page
from ..schemas import ENUMS, FOREIGN_KEYS
from ..session import scratch_path
from ..sources.fixtures import AS_OF
from ..sources.tables import append
from .registry import register, tables


# ---------------------------------------------------------------- W1 / W2 / F9 / M18 (Q37, Q38)
@register("latest_code")
def q_latest_code(spark, sf_dir):
    return Wn.latest_per(tables(spark, sf_dir)["email_verifications"], "user_id", ("created_at", "id"))


@register("live_codes")
def q_live_codes(spark, sf_dir):
    return live(tables(spark, sf_dir)["email_verifications"], AS_OF, attempts_col="attempts")


@register("trailing_attempts")
def q_trailing_attempts(spark, sf_dir):
    return Wn.trailing_count(tables(spark, sf_dir)["email_verifications"], "user_id", "created_at", 86400, limit=5)


@register("trailing_attempts_hour")
def q_trailing_attempts_hour(spark, sf_dir):
    return Wn.trailing_count(tables(spark, sf_dir)["email_verifications"], "user_id", "created_at", 3600, limit=5)


@register("trailing_attempts_spread")
def q_trailing_attempts_spread(spark, sf_dir):
    """W2 by prefix counts over ranges, as for keys with very many rows in one window, for all rows."""
    return Wn.trailing_count(tables(spark, sf_dir)["email_verifications"], "user_id", "created_at", 86400, limit=5,
                             hot_rows=0)


def _consume(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.consume_codes(t["email_verifications"], t["users"], t["code_submissions"])


@register("consume_codes")
def q_consume_codes(spark, sf_dir):
    return _consume(spark, sf_dir)["matched"]


@register("consume_codes_remaining")
def q_consume_codes_remaining(spark, sf_dir):
    return _consume(spark, sf_dir)["codes"]


@register("consume_codes_users")
def q_consume_codes_users(spark, sf_dir):
    return _consume(spark, sf_dir)["users"].select("id", "is_verified")


# ---------------------------------------------------------------- M14 / M6 tokens (Q39)
@register("token_purge")
def q_token_purge(spark, sf_dir):
    return M.purge_tokens(tables(spark, sf_dir)["refresh_tokens"], AS_OF)


def _rotate(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.rotate_tokens(t["refresh_tokens"], t["presented_tokens"], AS_OF)


@register("token_rotation")
def q_token_rotation(spark, sf_dir):
    return _rotate(spark, sf_dir)["tokens"]


@register("token_rotation_rejected")
def q_token_rotation_rejected(spark, sf_dir):
    return _rotate(spark, sf_dir)["rejected"]


# ---------------------------------------------------------------- W3 / W4 / W5
@register("default_address")
def q_default_address(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Wn.apply_exclusive_flag(t["addresses"], t["address_requests"])


@register("promote_main_image")
def q_promote_main_image(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Wn.promote_main_after_delete(t["product_images"], t["deleted_images"])


@register("first_image_flag")
def q_first_image_flag(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Wn.flag_first_uploads(t["product_images"], t["image_uploads"])


# ---------------------------------------------------------------- M2 / M3 / M22 / F12
@register("patch_coalesce")
def q_patch_coalesce(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.patch_coalesce(t["users"], t["user_changes"], "id", ["first_name", "last_name"])


@register("patch_present")
def q_patch_present(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.patch_present(t["products"], t["product_patches"], "id", ["name", "description", "stock", "status"])


def _profile(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.patch_user(t["users"], t["profile_changes"], ["first_name", "last_name", "email", "phone_number"])


@register("profile_patch")
def q_profile_patch(spark, sf_dir):
    return _profile(spark, sf_dir)[0]


@register("profile_patch_rejected")
def q_profile_patch_rejected(spark, sf_dir):
    return _profile(spark, sf_dir)[1]


# ---------------------------------------------------------------- M4 / M5 / M19 / M20 (Q19-Q21)
def _upsert(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.upsert_cart(t["carts"], t["cart_items"], t["products"], t["cart_changes"])


@register("cart_upsert")
def q_cart_upsert(spark, sf_dir):
    return _upsert(spark, sf_dir)["cart_items"]


@register("cart_upsert_rejected")
def q_cart_upsert_rejected(spark, sf_dir):
    return _upsert(spark, sf_dir)["rejected"]


@register("cart_upsert_carts")
def q_cart_upsert_carts(spark, sf_dir):
    return _upsert(spark, sf_dir)["carts"]


@register("cart_quantity_update")
def q_cart_quantity_update(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.update_cart_quantity(t["carts"], t["cart_items"], t["products"], t["cart_quantity_changes"])["cart_items"]


@register("cart_quantity_rejected")
def q_cart_quantity_rejected(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.update_cart_quantity(t["carts"], t["cart_items"], t["products"], t["cart_quantity_changes"])["rejected"]


@register("cart_clear")
def q_cart_clear(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.clear_carts(t["carts"], t["cart_items"], t["cart_clear_requests"])["cart_items"]


@register("cart_create_missing")
def q_cart_create_missing(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.create_missing_carts(t["carts"], t["users"])[0]


# ---------------------------------------------------------------- M6 / M7 / M8 (Q6, Q7, Q27)
@register("replace_features")
def q_replace_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.replace_children(t["product_features"], t["feature_replacements"], "product_id",
                              t["emptied_feature_parents"])


def _product_owners(t):
    p, s = t["products"], t["sellers"]
    return p.join(s.select(F.col("id").alias("__sid"), F.col("user_id").alias("owner_id")),
                  p["seller_id"] == F.col("__sid")).select(p["id"], "owner_id")


@register("owned_delete")
def q_owned_delete(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.owned_delete(t["products"], t["product_delete_requests"], _product_owners(t))["base"]


# The FK list over the derived test tables (orders are named shop_orders there).
_RENAMED = {"orders": "shop_orders"}
DERIVED_FKS = [(_RENAMED.get(c, c), col, _RENAMED.get(p, p), a) for c, col, p, a in FOREIGN_KEYS]
DERIVED_TABLES = ["users", "sellers", "products", "product_images", "product_features", "carts", "cart_items",
                  "blogs", "comments", "email_verifications", "product_categories", "categories", "addresses",
                  "shop_orders", "order_items", "refresh_tokens"]


def _cascade(spark, sf_dir):
    t = tables(spark, sf_dir)
    tabs = {n: t[n] for n in DERIVED_TABLES}
    roots = t["users"].where(~F.col("is_verified")).select("id")
    return M.cascade_delete(tabs, "users", roots, DERIVED_FKS)


@register("cascade_delete")
def q_cascade_delete(spark, sf_dir):
    """M8 from users (unverified ones): the refused roots with their RESTRICT reasons."""
    return _cascade(spark, sf_dir)["__rejected"]


@register("cascade_delete_rejected")
def q_cascade_delete_rejected(spark, sf_dir):
    return _cascade(spark, sf_dir)["__rejected"]


@register("cascade_delete_users")
def q_cascade_delete_users(spark, sf_dir):
    return _cascade(spark, sf_dir)["users"]


@register("cascade_delete_comments")
def q_cascade_delete_comments(spark, sf_dir):
    return _cascade(spark, sf_dir)["comments"]


@register("cascade_delete_addresses")
def q_cascade_delete_addresses(spark, sf_dir):
    return _cascade(spark, sf_dir)["addresses"]


@register("cascade_delete_blogs")
def q_cascade_delete_blogs(spark, sf_dir):
    return _cascade(spark, sf_dir)["blogs"].select("id", "author_id")


def _cascade_from(spark, sf_dir, table, roots_fn):
    t = tables(spark, sf_dir)
    tabs = {n: t[n] for n in DERIVED_TABLES}
    return M.cascade_delete(tabs, table, roots_fn(t), DERIVED_FKS)


def _unverified_carts(t):
    u = t["users"].where(~F.col("is_verified")).select(F.col("id").alias("__u"))
    return t["carts"].join(u, F.col("user_id") == F.col("__u"), "left_semi").select("id")


@register("cascade_delete_cart_items")
def q_cascade_delete_cart_items(spark, sf_dir):
    return _cascade_from(spark, sf_dir, "carts", _unverified_carts)["cart_items"]


@register("cascade_delete_carts")
def q_cascade_delete_carts(spark, sf_dir):
    return _cascade_from(spark, sf_dir, "carts", _unverified_carts)["carts"]


def _european_addresses(t):
    return t["addresses"].where(F.col("province") == "EUROPE").select("id")


@register("cascade_address_rejected")
def q_cascade_address_rejected(spark, sf_dir):
    return _cascade_from(spark, sf_dir, "addresses", _european_addresses)["__rejected"]


@register("cascade_address_remaining")
def q_cascade_address_remaining(spark, sf_dir):
    return _cascade_from(spark, sf_dir, "addresses", _european_addresses)["addresses"]


# ---------------------------------------------------------------- M10 / M11 / M16 (Q18, Q30)
def _status(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.order_status_change(t["shop_orders"], t["order_items"], t["products"], t["sellers"],
                                 t["order_status_changes"])


@register("order_status_change")
def q_order_status_change(spark, sf_dir):
    return _status(spark, sf_dir)["orders"]


@register("order_status_rejected")
def q_order_status_rejected(spark, sf_dir):
    return _status(spark, sf_dir)["rejected"]


def _moderate(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.moderate_comments(t["comments"], t["comment_moderation"])


@register("moderate_comments")
def q_moderate_comments(spark, sf_dir):
    return _moderate(spark, sf_dir)["comments"].select("id", "parent_type", "parent_id", "rating", "status")


@register("moderated_ratings")
def q_moderated_ratings(spark, sf_dir):
    res = _moderate(spark, sf_dir)
    touched = res["touched_parents"]
    new = A.ratings(res["comments"])
    out = touched.join(new, ["parent_type", "parent_id"], "left")
    return out.select("parent_type", "parent_id",
                      F.coalesce("n_ratings", F.lit(0).cast("bigint")).alias("n_ratings"),
                      F.coalesce("average_rating", F.lit(0).cast("decimal(3,2)")).alias("average_rating"))


# ---------------------------------------------------------------- M17 (Q14)
def _promote(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.promote_sellers(t["users"], t["sellers"], t["seller_requests"], as_of=AS_OF)


@register("promote_sellers")
def q_promote_sellers(spark, sf_dir):
    return _promote(spark, sf_dir)["sellers"]


@register("promote_sellers_rejected")
def q_promote_sellers_rejected(spark, sf_dir):
    return _promote(spark, sf_dir)["rejected"]


@register("promote_sellers_users")
def q_promote_sellers_users(spark, sf_dir):
    return _promote(spark, sf_dir)["users"].select("id", "role")


# ---------------------------------------------------------------- Q36 registration: C9 + F11 + M1
def _register(spark, sf_dir):
    t = tables(spark, sf_dir)
    reqs = t["registrations"]
    valid, violations = C.validate(reqs, C.registration_rules(), "request_id", "registrations")
    clash = find_conflicts(valid, t["users"], ["email", "phone_number"], incoming_id="request_id")
    ok = valid.join(clash.select("request_id"), "request_id", "left_anti")
    ok = M.first_of_batch(ok, ["email", "phone_number"], "request_id")["accepted"]
    new = ok.select(M.new_key(T.LongType(), "user", "request_id").alias("id"), "first_name", "last_name",
                    "email", "phone_number")
    _, inserted = M.insert(t["users"], new, "users", AS_OF)
    return {"violations": violations, "conflicts": clash, "inserted": inserted}


@register("validate_registrations")
def q_validate_registrations(spark, sf_dir):
    return _register(spark, sf_dir)["violations"]


@register("email_conflicts")
def q_email_conflicts(spark, sf_dir):
    return _register(spark, sf_dir)["conflicts"]


@register("register_users")
def q_register_users(spark, sf_dir):
    return _register(spark, sf_dir)["inserted"]


# ---------------------------------------------------------------- S3 / M21 / C10 / C11 (Q16)
def order_documents(t, tasks: int = 0):
    """Order documents (JSON text) built from line items: the payload shape of Q16. With ``tasks`` the order lines are
    held by their order in so many tasks, and the orders are dealt alike."""
    o = deal(t.raw("orders"), tasks, "o_orderkey")
    items = (t["order_items"].groupBy(F.col("order_id").alias("l_orderkey"))
             .agg(F.sort_array(F.collect_list(F.struct(
                 F.col("line_no").alias("n"), "product_id", "quantity", F.col("price_at_time").alias("price")))).alias("items")))
    pay = (F.when(F.col("o_orderpriority") == "1-URGENT", "credit_card")
            .when(F.col("o_orderpriority") == "5-LOW", "cash").otherwise("bank_transfer"))
    doc = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("address_id"), pay.alias("payment_method"),
                             F.col("items")))
    items = items.hint("shuffle_hash") if tasks else items  # no sort of the nested lines, of which a task has few
    return (o.join(items, o["o_orderkey"] == items["l_orderkey"], "left")
             .select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("user_id"), doc.alias("document")))


def checked_orders(t, tasks: int = 0):
    """The order documents that pass the rules, parsed (``__d``), and the violations of the others."""
    parsed = M.parse_once(order_documents(t, tasks), "document", M.ORDER_DOC_SCHEMA, "__d").select(
        "doc_id", "user_id", "__d", "__d.*")
    valid, violations = C.validate(parsed, C.order_document_rules(), "doc_id", "order_documents")
    return valid.select("doc_id", "user_id", "__d"), violations


def placed_orders(spark, sf_dir):
    valid, violations = checked_orders(tables(spark, sf_dir))
    return {"violations": violations, **M.place_orders(valid, parsed_col="__d")}


@register("validate_payloads")
def q_validate_payloads(spark, sf_dir):
    return placed_orders(spark, sf_dir)["violations"]


@register("place_orders")
def q_place_orders(spark, sf_dir):
    return placed_orders(spark, sf_dir)["orders"]


@register("place_orders_items")
def q_place_orders_items(spark, sf_dir):
    return placed_orders(spark, sf_dir)["order_items"]


# ---------------------------------------------------------------- Q11 / Q24 / Q30 / Q34 / Q5 write paths
def _rename(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.rename_unique(t["sellers"], t["seller_renames"], "id", ["shop_name"])


@register("seller_rename")
def q_seller_rename(spark, sf_dir):
    return _rename(spark, sf_dir)["base"]


@register("seller_rename_rejected")
def q_seller_rename_rejected(spark, sf_dir):
    return _rename(spark, sf_dir)["rejected"]


def _category_create(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.create_unique(t["categories"], t["new_categories"], "categories", ["fa_name", "en_name"], "category")


@register("category_create")
def q_category_create(spark, sf_dir):
    return _category_create(spark, sf_dir)["base"]


@register("category_create_rejected")
def q_category_create_rejected(spark, sf_dir):
    return _category_create(spark, sf_dir)["rejected"]


def _category_update(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.rename_unique(t["categories"], t["category_changes"], "id", ["fa_name", "en_name"])


@register("category_update")
def q_category_update(spark, sf_dir):
    return _category_update(spark, sf_dir)["base"]


@register("category_update_rejected")
def q_category_update_rejected(spark, sf_dir):
    return _category_update(spark, sf_dir)["rejected"]


def _address_delete(spark, sf_dir):
    t = tables(spark, sf_dir)
    owners = t["addresses"].select("id", F.col("user_id").alias("owner_id"))
    return M.owned_delete(t["addresses"], t["address_deletions"], owners)


@register("address_delete")
def q_address_delete(spark, sf_dir):
    return _address_delete(spark, sf_dir)["base"]


@register("address_delete_rejected")
def q_address_delete_rejected(spark, sf_dir):
    return _address_delete(spark, sf_dir)["rejected"]


@register("cart_quantity_touched")
def q_cart_quantity_touched(spark, sf_dir):
    """M5 + M15: the carts that quantity changes touch."""
    t = tables(spark, sf_dir)
    carts = t["carts"].withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return M.update_cart_quantity(carts, t["cart_items"], t["products"], t["cart_quantity_changes"],
                                  as_of=AS_OF)["carts"]


@register("moderate_comments_rejected")
def q_moderate_comments_rejected(spark, sf_dir):
    """Changes refused for an unknown status or comment, over the staged comments' states."""
    t = tables(spark, sf_dir)
    asked = t["staged_comments"].select((F.col("id") * 2).alias("comment_id"), "status",
                                        F.lit(AS_OF).cast("timestamp").alias("change_ts"), F.col("id").alias("seq"))
    return M.moderate_comments(t["comments"], asked)["rejected"].drop("change_ts")


@register("orders_deep_page")
def q_orders_deep_page(spark, sf_dir):
    """L2 at a deep offset: orders by total, found by counting ranges instead of keeping offset + limit rows."""
    return deep_page(tables(spark, sf_dir)["shop_orders"], "total_amount", "DESC", limit=100, offset=1000)


def _comment_create(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.create_comments(t["comments"], t["new_comments"], {"product": t["products"], "blog": t["blogs"]}, t["users"])


@register("comment_create")
def q_comment_create(spark, sf_dir):
    return _comment_create(spark, sf_dir)["inserted"]


@register("comment_append")
def q_comment_append(spark, sf_dir):
    """The created comments appended to a table and read back as written; the retry of the batch adds nothing."""
    created = _comment_create(spark, sf_dir)["inserted"]
    path = scratch_path(spark, f"comments-{uuid.uuid4().hex}")
    append(created, path, "first")
    return append(created, path, "first")


@register("comment_create_rejected")
def q_comment_create_rejected(spark, sf_dir):
    return _comment_create(spark, sf_dir)["rejected"]


@register("address_create")
def q_address_create(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.create_addresses(t["addresses"], t["new_addresses"])


def product_documents(t):
    """Product documents (JSON text) built from parts: the payload shape of Q5."""
    p = t.raw("part")
    owner = t["products"].select(F.col("id").alias("__id"), "seller_id")
    cats = F.when(F.col("p_size") == 2, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    doc = F.to_json(F.struct(
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") == 1, F.lit(0)).otherwise(F.round(F.col("p_retailprice") * 100)).cast("bigint").alias("price"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("int").alias("stock"),
        cats.alias("categories"),
        F.array(F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value"))).alias("features")))
    return (p.join(owner, p["p_partkey"] == owner["__id"])
             .select(F.col("p_partkey").alias("doc_id"), "seller_id", doc.alias("document")))


def _create_products(spark, sf_dir):
    return M.create_products(product_documents(tables(spark, sf_dir)))


@register("create_products")
def q_create_products(spark, sf_dir):
    return _create_products(spark, sf_dir)["products"]


@register("create_products_bridge")
def q_create_products_bridge(spark, sf_dir):
    return _create_products(spark, sf_dir)["product_categories"]


@register("create_products_features")
def q_create_products_features(spark, sf_dir):
    return _create_products(spark, sf_dir)["product_features"]


@register("validate_products")
def q_validate_products(spark, sf_dir):
    return _create_products(spark, sf_dir)["violations"]


def _comment_delete(spark, sf_dir):
    t = tables(spark, sf_dir)
    c = t["comments"]
    owners = c.select("id", F.col("user_id").alias("owner_id"))
    res = M.owned_delete(c, t["comment_deletions"], owners, admin_col="is_admin")
    deleted = res["deleted"].select("parent_type", "parent_id").distinct()
    # Recompute averages of the touched parents from what is left (D12: never stale).
    ratings = deleted.join(A.ratings(res["base"]), ["parent_type", "parent_id"], "left").select(
        "parent_type", "parent_id", F.coalesce("n_ratings", F.lit(0).cast("bigint")).alias("n_ratings"),
        F.coalesce("average_rating", F.lit(0).cast("decimal(3,2)")).alias("average_rating"))
    return {**res, "ratings": ratings}


@register("comment_delete")
def q_comment_delete(spark, sf_dir):
    return _comment_delete(spark, sf_dir)["base"]


@register("comment_delete_ratings")
def q_comment_delete_ratings(spark, sf_dir):
    return _comment_delete(spark, sf_dir)["ratings"]


def _cart_remove(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.remove_cart_items(t["carts"], t["cart_items"], t["cart_removals"])


@register("cart_remove")
def q_cart_remove(spark, sf_dir):
    return _cart_remove(spark, sf_dir)["cart_items"]


@register("cart_remove_rejected")
def q_cart_remove_rejected(spark, sf_dir):
    return _cart_remove(spark, sf_dir)["rejected"]


def _blog_create(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.create_blogs(t["blogs"], t["new_blogs"])


@register("blog_create")
def q_blog_create(spark, sf_dir):
    return _blog_create(spark, sf_dir)["inserted"]


@register("blog_create_rejected")
def q_blog_create_rejected(spark, sf_dir):
    return _blog_create(spark, sf_dir)["rejected"].select("author_id", "title", "seq", "reason")


def _product_update(spark, sf_dir):
    from . import reports as R
    t = tables(spark, sf_dir)
    return R.update_products(t, t["product_update_patches"], t["product_update_categories"],
                             t["product_update_features"])


@register("product_update")
def q_product_update(spark, sf_dir):
    return _product_update(spark, sf_dir)["products"]


@register("product_update_bridge")
def q_product_update_bridge(spark, sf_dir):
    return _product_update(spark, sf_dir)["product_categories"]


@register("product_update_features")
def q_product_update_features(spark, sf_dir):
    return _product_update(spark, sf_dir)["product_features"]


@register("product_update_rejected")
def q_product_update_rejected(spark, sf_dir):
    return _product_update(spark, sf_dir)["rejected"].select("id", "requester_id", "seq", "reason")


_PRODUCT_CASCADE = ["products", "product_images", "product_features", "cart_items", "product_categories",
                    "order_items"]


def _product_delete(spark, sf_dir):
    from . import reports as R
    t = tables(spark, sf_dir)
    return R.delete_products(t, t["product_delete_batch"], DERIVED_FKS, _PRODUCT_CASCADE)


@register("product_delete_refused")
def q_product_delete_refused(spark, sf_dir):
    return _product_delete(spark, sf_dir)["refused"]


@register("product_delete_products")
def q_product_delete_products(spark, sf_dir):
    return _product_delete(spark, sf_dir)["products"]


def _address_update(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.update_addresses(t["addresses"], t["address_changes"], ["address", "city"])


@register("address_update")
def q_address_update(spark, sf_dir):
    return _address_update(spark, sf_dir)["addresses"]


@register("address_update_rejected")
def q_address_update_rejected(spark, sf_dir):
    return _address_update(spark, sf_dir)["rejected"]


@register("first_image_flag_owned")
def q_first_image_flag_owned(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Wn.flag_first_uploads(t["product_images"], t["owned_uploads"], owners=_product_owners(t))


@register("live_tokens")
def q_live_tokens(spark, sf_dir):
    return live(tables(spark, sf_dir)["refresh_tokens"], AS_OF, revoked_col="is_revoked")


# ---------------------------------------------------------------- S1 / S5
@register("category_list")
def q_category_list(spark, sf_dir):
    return tables(spark, sf_dir)["categories"]


@register("export_documents")
def q_export_documents(spark, sf_dir):
    from ..sources.tables import to_documents
    t = tables(spark, sf_dir)
    return to_documents(t["products"].select("id", "name", "price", "description", "stock", "status"), key="id")


# ---------------------------------------------------------------- C1 .. C13 audits
@register("audit_keys")
def q_audit_keys(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.union_all([
        C.unique_key(t["users"], "users", ["email"]), C.unique_key(t["users"], "users", ["phone_number"]),
        C.unique_key(t["sellers"], "sellers", ["shop_name"]),
        C.unique_key(t["categories"], "categories", ["fa_name", "en_name"]),
        C.unique_key(t["product_categories"], "product_categories", ["product_id", "category_id"]),
        C.unique_key(t["refresh_tokens"], "refresh_tokens", ["token"]),
        C.unique_key(t["order_items"], "order_items", ["order_id", "line_no"], key="order_id")])


@register("audit_orphans")
def q_audit_orphans(spark, sf_dir):
    t = tables(spark, sf_dir)
    fks = [(child, col, parent) for child, col, parent, _ in DERIVED_FKS
           if child in DERIVED_TABLES and parent in DERIVED_TABLES and col in t[child].columns]
    fks += [("staged_comments", "user_id", "users"), ("staged_lines", "product_id", "products")]
    names = sorted({name for child, _, parent in fks for name in (child, parent)})
    # carts and their lines are fewer than the orders and lines they are made of, whose count needs no join
    counted = {"carts": "shop_orders", "cart_items": "order_items"}
    n = dict(zip(names, row_counts([t[counted.get(name, name)] for name in names]), strict=True))
    return C.union_all([C.orphans(t[child], child, col, t[parent], counts=(n[child], n[parent]))
                        for child, col, parent in fks])


@register("audit_polymorphic")
def q_audit_polymorphic(spark, sf_dir):
    t = tables(spark, sf_dir)
    parents = {"product": (t["products"], "id"), "blog": (t["blogs"], "id")}
    return C.polymorphic_orphans(t["comments"].select("id", "parent_type", "parent_id").unionByName(
        t["staged_comments"].select("id", "parent_type", "parent_id")), parents)


AUDITED = {"users": "users", "sellers": "sellers", "products": "products", "comments": "comments", "blogs": "blogs",
           "shop_orders": "shop_orders", "cart_items": "cart_items", "categories": "categories",
           "staged_users": "users", "staged_comments": "comments", "staged_lines": "order_items"}


@register("audit_domains")
def q_audit_domains(spark, sf_dir):
    """All domain rules of each table in one pass over it."""
    t = tables(spark, sf_dir)
    keys = {"cart_items": "cart_id", "staged_lines": "order_id"}
    return C.union_all([C.validate(t[name], C.domain_rules(kind), keys.get(name, "id"), name)[1]
                        for name, kind in AUDITED.items()])


PAYLOADS = {"staged_comments": ("comment_create", "id"), "new_blogs": ("blog_create", "seq"),
            "staged_lines": ("cart_create", "order_id"), "new_addresses": ("address_create", "seq"),
            "new_categories": ("category_create", "seq"), "category_changes": ("category_update", "seq"),
            "blog_changes": ("blog_update", "seq")}


@register("validate_change_payloads")
def q_validate_change_payloads(spark, sf_dir):
    """The payload rules of comments, blogs, cart lines, addresses and categories, one pass over each."""
    t = tables(spark, sf_dir)
    return C.union_all([C.validate(t[name], C.payload_rules(kind), key, name)[1]
                        for name, (kind, key) in PAYLOADS.items()])


@register("validate_profile_patches")
def q_validate_profile_patches(spark, sf_dir):
    """Profile patches with phone numbers of addresses' postal codes as landlines."""
    t = tables(spark, sf_dir)
    patches = t["staged_users"].select("id", "first_name", "last_name", "email", "phone_number",
                                       F.col("last_name").alias("home_address"),
                                       F.concat(F.lit("021"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("home_phone_number"))
    return C.validate(patches, C.user_patch_rules(), "id", "profile_patches")[1]


@register("audit_stock")
def q_audit_stock(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.stock_cover(t["cart_items"], t["products"])


@register("audit_flags")
def q_audit_flags(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.union_all([C.at_most_one_flag(t["product_images"], "product_images", "product_id", "is_main"),
                        C.at_most_one_flag(t["staged_images"], "staged_images", "product_id", "is_main"),
                        C.at_most_one_flag(t["addresses"], "addresses", "user_id", "is_default"),
                        C.at_most_one_flag(Wn.apply_exclusive_flag(t["addresses"], t["address_requests"]),
                                           "addresses_after_requests", "user_id", "is_default")])


@register("validate_uploads")
def q_validate_uploads(spark, sf_dir):
    return C.validate_uploads(tables(spark, sf_dir)["uploads"])
