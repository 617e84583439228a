"""Query registrations over the derived marketplace tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import reports as R
from .registry import register, tables


# ---------------------------------------------------------------- Q15 / A18
@register("seller_leaderboard")
def q_seller_leaderboard(spark, sf_dir):
    return R.seller_leaderboard(tables(spark, sf_dir), sort_by="created_at", order="DESC", limit=10, offset=0)


@register("seller_leaderboard_by_rating")
def q_seller_leaderboard_by_rating(spark, sf_dir):
    return R.seller_leaderboard(tables(spark, sf_dir), status="active", sort_by="rating", order="DESC",
                                limit=20, offset=5)


@register("seller_scorecard")
def q_seller_scorecard(spark, sf_dir):
    return R.seller_leaderboard_full(tables(spark, sf_dir), sort_by="status", order="ASC")


@register("seller_leaderboard_count")
def q_seller_leaderboard_count(spark, sf_dir):
    return R.seller_leaderboard_count(tables(spark, sf_dir), status="active", limit=10, offset=0)


# ---------------------------------------------------------------- flattening for comparison
def _rows_text(col: str, fields: list[str]):
    """A nested list as text: each element's fields joined by ``:`` (nulls left out), in the order of its id."""
    parts = F.transform(col, lambda x: F.struct(x["id"].alias("id"), F.concat_ws(
        ":", *[x[f].cast("string") for f in fields]).alias("text")))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), ",")


def _flat(df, nested: dict[str, str]):
    """Replace nested columns with sorted text; ``nested`` maps column -> kind."""
    out = df
    for col, kind in nested.items():
        if col not in out.columns:
            continue
        if kind.startswith("rows:"):
            out = out.withColumn(col, _rows_text(col, kind[5:].split(",")))
            continue
        if kind == "pairs":
            out = out.withColumn("feature_pairs", F.array_join(
                F.transform(col, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";"))
        elif kind == "text":
            out = out.withColumn(col, F.array_join(col, ","))
            continue
        elif kind.startswith("struct:"):
            for f in kind[7:].split(","):
                out = out.withColumn(f"{col}_{f}", F.col(f"{col}.{f}"))
        out = out.drop(col)
    return out


_PRODUCT_NEST = {"categories": "rows:id,fa_name,en_name", "images": "rows:id,image_url,is_main", "features": "pairs"}


# ---------------------------------------------------------------- Q1 / Q2 / Q3 / Q4
@register("catalogue_page")
def q_catalogue_page(spark, sf_dir):
    return _flat(R.catalogue_page(tables(spark, sf_dir)), _PRODUCT_NEST)


_CAT_ARGS = dict(category="Brand#4", min_price=90000, max_price=98000, q="R")


@register("catalogue_page_filtered")
def q_catalogue_page_filtered(spark, sf_dir):
    return _flat(R.catalogue_page(tables(spark, sf_dir), sort_by="price", order="ASC", limit=10, offset=5,
                                  **_CAT_ARGS), _PRODUCT_NEST)


@register("catalogue_count")
def q_catalogue_count(spark, sf_dir):
    return R.catalogue_count(tables(spark, sf_dir), limit=10, offset=5, **_CAT_ARGS)


@register("page_info")
def q_page_info(spark, sf_dir):
    """A1 + L5 for the default catalogue listing (active products), page 3 of 10."""
    return R.catalogue_count(tables(spark, sf_dir), limit=10, offset=20)


@register("new_arrivals")
def q_new_arrivals(spark, sf_dir):
    return _flat(R.new_arrivals(tables(spark, sf_dir)), _PRODUCT_NEST)


@register("product_lookup")
def q_product_lookup(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = t["comments"].where(F.col("parent_type") == "product").select(F.col("parent_id").alias("id"))
    return _flat(R.product_details(t, keys), _PRODUCT_NEST)


@register("category_products")
def q_category_products(spark, sf_dir):
    return _flat(R.category_products(tables(spark, sf_dir), "LARGE", sort_by="price", order="DESC",
                                     limit=10, offset=10), _PRODUCT_NEST)


@register("category_products_count")
def q_category_products_count(spark, sf_dir):
    return R.category_products_count(tables(spark, sf_dir), "LARGE", limit=10, offset=10)


# ---------------------------------------------------------------- Q9 / Q23
@register("seller_profiles")
def q_seller_profiles(spark, sf_dir):
    return R.seller_profiles(tables(spark, sf_dir))


@register("category_lookup")
def q_category_lookup(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = t["product_features"].select(F.col("value").alias("id"))
    return R.lookup(t["categories"], keys, "id", "id", missing="flag")


# ---------------------------------------------------------------- Q10
_SELLER_NEST = {"categories": "rows:id,fa_name,en_name", "images": "rows:id,url,is_main"}


@register("seller_products")
def q_seller_products(spark, sf_dir):
    return _flat(R.seller_products(tables(spark, sf_dir), sort_by="price", order="DESC", limit=5, offset=0),
                 _SELLER_NEST)


@register("seller_products_filtered")
def q_seller_products_filtered(spark, sf_dir):
    return _flat(R.seller_products(tables(spark, sf_dir), status="active", min_price="92000",
                                   max_price="97000.5x", search="ring", sort_by="status", order="asc",
                                   limit="abc", offset="1"), _SELLER_NEST)


@register("seller_products_count")
def q_seller_products_count(spark, sf_dir):
    return R.seller_products_count(tables(spark, sf_dir), status="active", search="ring", limit="abc", offset="1")


@register("seller_products_count_filtered")
def q_seller_products_count_filtered(spark, sf_dir):
    return R.seller_products_count(tables(spark, sf_dir), status="active", category="Brand#4", min_price="92000",
                                   max_price="97000.5x", limit="5", offset="0")


# ---------------------------------------------------------------- Q12 / Q13 / Q17
@register("seller_orders")
def q_seller_orders(spark, sf_dir):
    return R.seller_orders(tables(spark, sf_dir), dedupe=True)


@register("seller_orders_raw")
def q_seller_orders_raw(spark, sf_dir):
    return R.seller_orders(tables(spark, sf_dir), dedupe=False)


@register("seller_statistics")
def q_seller_statistics(spark, sf_dir):
    from ..operators.metrics import seller_statistics
    t = tables(spark, sf_dir)
    return seller_statistics(t["sellers"], t["products"], t["order_items"], t["shop_orders"], t["comments"])


@register("my_orders")
def q_my_orders(spark, sf_dir):
    return R.orders_with_address(tables(spark, sf_dir))


# ---------------------------------------------------------------- Q19 / Q22
@register("cart_lines")
def q_cart_lines(spark, sf_dir):
    return R.cart_lines(tables(spark, sf_dir))


@register("cart_summary")
def q_cart_summary(spark, sf_dir):
    return _flat(R.cart_summary(tables(spark, sf_dir)), {"sellers": "text"})


@register("cart_contains")
def q_cart_contains(spark, sf_dir):
    t = tables(spark, sf_dir)
    o, oi = t["shop_orders"], t["order_items"]
    pairs = o.join(oi, o["id"] == oi["order_id"]).select(o["user_id"], oi["product_id"])
    return R.cart_contains(t, pairs)


# ---------------------------------------------------------------- Q26
@register("blog_listing")
def q_blog_listing(spark, sf_dir):
    return _flat(R.blog_listing(tables(spark, sf_dir)), {"tags": "text"})


@register("blog_listing_by_views")
def q_blog_listing_by_views(spark, sf_dir):
    return _flat(R.blog_listing(tables(spark, sf_dir), category="en", sort_by="views", order="DESC",
                                limit=10, offset=10), {"tags": "text"})


@register("blog_listing_all")
def q_blog_listing_all(spark, sf_dir):
    return _flat(R.blog_listing(tables(spark, sf_dir), per_page=False), {"tags": "text"})


@register("blog_count")
def q_blog_count(spark, sf_dir):
    return R.blog_count(tables(spark, sf_dir), category="en", limit=10, offset=10)


@register("blog_lookup")
def q_blog_lookup(spark, sf_dir):
    """Every id that a blog comment names, and twice that (half of those do not exist)."""
    t = tables(spark, sf_dir)
    named = t["comments"].where(F.col("parent_type") == "blog").select(F.explode(F.array(
        F.col("parent_id"), F.col("parent_id") * 2)).alias("id"))
    return R.blog_details(t, named).select("id", "found", "title", "category", "views", "author_id")


@register("blog_update")
def q_blog_update(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.update_blogs(t, t["blog_changes"])["blogs"]


@register("blog_update_rejected")
def q_blog_update_rejected(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.update_blogs(t, t["blog_changes"])["rejected"]


def _blog_delete(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = t["blog_changes"].where(F.col("title").isNull()).select("id")
    fks = [("blog_tags", "blog_id", "blogs", "cascade")]
    return R.delete_blogs(t, keys, fks, ["blogs", "blog_tags"])


@register("blog_delete")
def q_blog_delete(spark, sf_dir):
    return _blog_delete(spark, sf_dir)["blogs"]


@register("blog_delete_tags")
def q_blog_delete_tags(spark, sf_dir):
    return _blog_delete(spark, sf_dir)["blog_tags"]


@register("blog_delete_unknown")
def q_blog_delete_unknown(spark, sf_dir):
    return _blog_delete(spark, sf_dir)["__unknown"]


# ---------------------------------------------------------------- Q28 / Q29
_MOD_NEST = {"user": "struct:id,first_name,last_name,email", "parent_item": "struct:id,name,title"}


@register("moderation_list")
def q_moderation_list(spark, sf_dir):
    return _flat(R.moderation_list(tables(spark, sf_dir)), _MOD_NEST)


@register("moderation_list_filtered")
def q_moderation_list_filtered(spark, sf_dir):
    return _flat(R.moderation_list(tables(spark, sf_dir), parent_type="Product", search="PURCH",
                                   sort_by="status", order="ASC", limit=15, offset=3), _MOD_NEST)


@register("moderation_count")
def q_moderation_count(spark, sf_dir):
    return R.moderation_count(tables(spark, sf_dir), parent_type="Product", search="PURCH", limit=15, offset=3)


@register("public_comments")
def q_public_comments(spark, sf_dir):
    return R.public_comments(tables(spark, sf_dir), limit=10, offset=0)


@register("public_comments_count")
def q_public_comments_count(spark, sf_dir):
    return R.public_comments_count(tables(spark, sf_dir), limit=3, offset=0)


@register("public_comments_admin")
def q_public_comments_admin(spark, sf_dir):
    return R.public_comments(tables(spark, sf_dir), viewer_role="admin", status="rejected", limit=3, offset=1)


# ---------------------------------------------------------------- Q31 / Q33 / Q35
_SELLER_STRUCT = {"seller": "struct:id,shop_name,status,rating"}


@register("user_with_seller")
def q_user_with_seller(spark, sf_dir):
    return _flat(R.users_with_seller(tables(spark, sf_dir)), _SELLER_STRUCT)


@register("addresses_ordered")
def q_addresses_ordered(spark, sf_dir):
    return R.addresses_ordered(tables(spark, sf_dir))


_USER_NEST = {"seller_info": "struct:id,shop_name,status,rating"}


@register("user_listing")
def q_user_listing(spark, sf_dir):
    return _flat(R.user_listing(tables(spark, sf_dir)), _USER_NEST)


@register("user_listing_filtered")
def q_user_listing_filtered(spark, sf_dir):
    return _flat(R.user_listing(tables(spark, sf_dir), is_verified="true", search="00001", sort_by="email",
                                order="ASC", limit=10, offset=2), _USER_NEST)


@register("user_listing_by_role")
def q_user_listing_by_role(spark, sf_dir):
    return _flat(R.user_listing(tables(spark, sf_dir), is_verified="yes", sort_by="role", order="DESC",
                                limit=10, offset=0), _USER_NEST)


@register("user_count")
def q_user_count(spark, sf_dir):
    return R.user_count(tables(spark, sf_dir), is_verified="true", search="00001", limit=10, offset=2)


# ---------------------------------------------------------------- A6 / A11 / A14 / A15 / A16 / M9 / M16
@register("ratings")
def q_ratings(spark, sf_dir):
    from ..operators.metrics import ratings
    return ratings(tables(spark, sf_dir)["comments"])


@register("ratings_written_back")
def q_ratings_written_back(spark, sf_dir):
    from ..operators.metrics import write_back_ratings
    t = tables(spark, sf_dir)
    p = write_back_ratings(t["products"], t["comments"], "product").select(
        F.lit("product").alias("parent_type"), "id", "average_rating")
    b = write_back_ratings(t["blogs"], t["comments"], "blog").select(
        F.lit("blog").alias("parent_type"), "id", "average_rating")
    return p.unionByName(b)


@register("single_category_products")
def q_single_category_products(spark, sf_dir):
    from ..operators.metrics import single_category_products
    return single_category_products(tables(spark, sf_dir)["product_categories"])


def _category_delete(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.category_delete(t, t["categories"].select("id"))


@register("category_delete")
def q_category_delete(spark, sf_dir):
    return _category_delete(spark, sf_dir)["refused"]


@register("category_delete_names")
def q_category_delete_names(spark, sf_dir):
    t = tables(spark, sf_dir)
    asked = t["categories"].where(F.col("en_name").startswith("S")).select("id")
    return R.blocking_names(_category_delete(spark, sf_dir)["blocking"], asked)


@register("category_delete_blocking")
def q_category_delete_blocking(spark, sf_dir):
    return _category_delete(spark, sf_dir)["blocking"]


@register("category_delete_remaining")
def q_category_delete_remaining(spark, sf_dir):
    return _category_delete(spark, sf_dir)["categories"]


@register("category_delete_bridge")
def q_category_delete_bridge(spark, sf_dir):
    return _category_delete(spark, sf_dir)["product_categories"]


@register("order_totals")
def q_order_totals(spark, sf_dir):
    from ..operators.metrics import order_totals
    return order_totals(tables(spark, sf_dir)["order_items"])


@register("best_sellers")
def q_best_sellers(spark, sf_dir):
    from ..operators.metrics import best_sellers
    t = tables(spark, sf_dir)
    return best_sellers(t["products"], t["order_items"], t["shop_orders"], k=10)
