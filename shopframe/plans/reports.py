"""Named reports: thin compositions of the operators.

Each takes a ``tables`` mapping (name -> DataFrame) holding the
marketplace tables, and explicit parameters instead of request fields.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.ordering import multi_order, order_spec
from ..functions.text import preview
from ..operators import changes as M
from ..operators import metrics as A
from ..operators import nest as N
from ..operators.dealing import deal, row_counts, tasks_for
from ..operators.paging import DEFAULT_LIMIT, in_page_order, of_page, page_info, page_per_key, page_rows
from ..schemas import ENUMS

Tables = Mapping[str, DataFrame]

SELLER_SORT = ["created_at", "shop_name", "status", "rating"]
SELLER_ENUMS = {"status": ENUMS["seller_status"]}
PARENTS_A_TASK = 50_000  # rows that one task holds with their children


# ---------------------------------------------------------------- Q15 (flagship)
def seller_leaderboard(t: Tables, status: str | None = None, sort_by: str = "created_at",
                       order: str = "DESC", limit: int = DEFAULT_LIMIT, offset: int = 0,
                       with_distinct_orders: bool = False) -> DataFrame:
    """A page of the seller scorecard (Q15): one pass over order lines.

    ``with_distinct_orders`` adds the order count (D10), which needs a second
    pass over the lines (orders cannot be counted from per-product totals).
    """
    spec = order_spec(sort_by, order, SELLER_SORT, enums=SELLER_ENUMS)
    # The sort keys are seller columns, so the page is found before any
    # order line is read; metrics are then computed for those sellers only.
    s = t["sellers"] if status is None else t["sellers"].where(F.col("status") == status)
    u = t["users"].select(F.col("id").alias("__uid"))
    rows = page_rows(s.join(u, s["user_id"] == u["__uid"], "inner").drop("__uid"), spec, limit, offset)
    board = A.seller_scorecard(rows, t["users"], t["products"], t["order_items"], t["shop_orders"],
                               with_distinct_orders=with_distinct_orders, seller_page=(rows, limit))
    return in_page_order(board, spec, limit)


def seller_leaderboard_full(t: Tables, status: str | None = None, sort_by: str = "created_at",
                            order: str = "DESC", with_distinct_orders: bool = True) -> DataFrame:
    """The whole scorecard in leaderboard order (every page at once)."""
    spec = order_spec(sort_by, order, SELLER_SORT, enums=SELLER_ENUMS)
    return A.seller_scorecard(t["sellers"], t["users"], t["products"], t["order_items"],
                              t["shop_orders"], status=status,
                              with_distinct_orders=with_distinct_orders).orderBy(*spec)


def seller_leaderboard_count(t: Tables, status: str | None = None, limit: int = DEFAULT_LIMIT,
                             offset: int = 0) -> DataFrame:
    s = t["sellers"] if status is None else t["sellers"].where(F.col("status") == status)
    u = t["users"].select(F.col("id").alias("__uid"))
    joined = s.join(u, s["user_id"] == u["__uid"], "inner")
    return page_info(joined, limit, offset)


def present(df: DataFrame, cols: Sequence) -> list:
    """Keep the wanted columns that exist in ``df`` (inputs may omit optional ones)."""
    out = []
    for c in cols:
        name = c[0] if isinstance(c, tuple) else c
        if name in df.columns:
            out.append(F.col(name).alias(c[1]) if isinstance(c, tuple) else F.col(name))
    return out


# ---------------------------------------------------------------- product cards
PRODUCT_COLS = ["id", "name", "price", "description", "stock", "status", "created_at", "updated_at"]


def with_seller(products: DataFrame, sellers: DataFrame, page_size: int | None = None) -> DataFrame:
    """Left join seller name and rating (J2): products without a seller keep nulls.

    With ``page_size`` the products are one page, so only the sellers they
    name are kept first and the seller table is not shuffled.
    """
    s = sellers.select(F.col("id").alias("__sid"), F.col("shop_name").alias("seller_name"),
                       F.col("rating").alias("seller_rating"))
    if page_size:
        s = of_page(s, "__sid", products, page_size, "seller_id")
    return products.join(s, products["seller_id"] == s["__sid"], "left").drop("__sid")


def attach_product_children(rows: DataFrame, t: Tables, page_size: int | None = None, empty: str = "null",
                            image_url_field: str = "image_url", with_features: bool = True,
                            n_rows: int = 0) -> DataFrame:
    """Categories, images and features of the given product rows.

    Children are first restricted to the rows' ids, then aggregated; with
    ``page_size`` the rows are one page and the children are not shuffled
    for that. ``n_rows`` is about the number of rows otherwise; it and the
    children's number bound what one task nests.
    """
    def only(child, fk):
        if page_size:
            return of_page(child, fk, rows, page_size)
        return child.join(rows.select(F.col("id").alias("__k")).distinct(), F.col(fk) == F.col("__k"),
                          "left_semi")

    bridge = only(t["product_categories"], "product_id")
    cats = bridge.join(t["categories"], bridge["category_id"] == t["categories"]["id"], "inner").select(
        "product_id", t["categories"]["id"], "fa_name", "en_name")
    specs = [(cats, "product_id", ["id", "fa_name", "en_name"], "categories"),
             (only(t["product_images"], "product_id"), "product_id",
              ["id", ("image_url", image_url_field), "is_main"], "images")]
    if with_features:
        specs.append((only(t["product_features"], "product_id"), "product_id", ["name", "value"], "features"))
    # one union + one aggregation for all collections (one shuffle instead of three)
    children = [] if page_size else row_counts([t[c] for c in ("product_categories", "product_images", "product_features")])
    return N.nest_many(rows, "id", specs, empty, max(tasks_for(n_rows, PARENTS_A_TASK), tasks_for(sum(children))))


def product_page(t: Tables, filtered: DataFrame, spec, limit: int, offset: int) -> DataFrame:
    """Page first, then nest: children are aggregated for the page's rows only."""
    cols = present(filtered, PRODUCT_COLS + ["seller_id"])
    rows = page_rows(filtered.select(*cols), spec, limit, offset)
    out = with_seller(rows, t["sellers"], page_size=limit).drop("seller_id")
    out = attach_product_children(out, t, page_size=limit)
    return in_page_order(out, spec, limit)


# ---------------------------------------------------------------- Q1 catalogue
CATALOGUE_SORT = ["created_at", "price", "name"]


def catalogue_filter(t: Tables, category: str | None = None, min_price=None, max_price=None,
                     q: str | None = None) -> DataFrame:
    p = t["products"]
    p = P.where_all(p, [F.col("status") == "active", P.between_if("price", min_price, max_price),
                        P.search(q, ["name", "description"])])
    if category:
        b = t["product_categories"].where(F.col("category_id") == F.lit(category))
        p = p.join(b.select(F.col("product_id").alias("__pid")), p["id"] == F.col("__pid"), "left_semi")
    return p


def catalogue_page(t: Tables, category=None, min_price=None, max_price=None, q=None,
                   sort_by: str = "created_at", order: str = "DESC", limit: int = DEFAULT_LIMIT,
                   offset: int = 0) -> DataFrame:
    """Q1: filtered, sorted page of active products with nested children."""
    spec = order_spec(sort_by, order, CATALOGUE_SORT)
    return product_page(t, catalogue_filter(t, category, min_price, max_price, q), spec, limit, offset)


def catalogue_count(t: Tables, category=None, min_price=None, max_price=None, q=None,
                    limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q1 pagination block: count(distinct id) with the page's filters."""
    f = catalogue_filter(t, category, min_price, max_price, q)
    return page_info(f, limit, offset, count_expr=F.count_distinct("id"))


# ---------------------------------------------------------------- Q2 / Q3 / Q4
def new_arrivals(t: Tables, k: int = 10) -> DataFrame:
    """Q2: newest ``k`` active products with children (L3)."""
    spec = order_spec("created_at", "DESC")
    active = t["products"].where(F.col("status") == "active")
    return product_page(t, active, spec, k, 0)


def lookup(df: DataFrame, keys: DataFrame, on: str = "id", key_col: str | None = None,
           missing: str = "drop", tasks: int = 0) -> DataFrame:
    """Batched key lookup (S2): rows of ``df`` for each requested key.

    ``missing='flag'`` keeps unknown keys with ``found = false`` (the
    single-id form answered "not found"). Keys are de-duplicated first. ``tasks``
    deals flagged keys and rows to so many tasks.
    """
    key_col = key_col or on
    ks = keys.select(F.col(key_col).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    if missing == "drop":
        return df.join(ks, df[on] == ks["__key"], "left_semi")
    if missing != "flag":
        raise ValueError("missing must be 'drop' or 'flag'")
    hit = df.withColumn("__hit", F.lit(True))
    ks, hit = deal(ks, tasks, "__key"), deal(hit, tasks, on)
    out = ks.join(hit, ks["__key"] == hit[on], "left")
    out = out.withColumn("found", F.coalesce(F.col("__hit"), F.lit(False)))
    return out.withColumn(on, F.col("__key")).drop("__key", "__hit") if on in df.columns else out


def product_details(t: Tables, keys: DataFrame, key_col: str = "id") -> DataFrame:
    """Q3 for a batch of ids: found flag, product columns, seller, children."""
    prods = t["products"].select(*present(t["products"], PRODUCT_COLS + ["seller_id"]))
    n_keys = keys.agg(F.approx_count_distinct(key_col)).first()[0]  # unknown keys come out as rows, too
    found = lookup(prods, keys, "id", key_col, missing="flag",
                   tasks=tasks_for(max(n_keys, prods.count()), PARENTS_A_TASK))
    out = with_seller(found, t["sellers"]).drop("seller_id")
    return attach_product_children(out, t, n_rows=n_keys)


CATEGORY_SORT = ["created_at", "price", "name", "updated_at"]


def category_filter(t: Tables, category: str) -> DataFrame:
    """Active products in the category given by id (as text) or English name."""
    cats = t["categories"].where(P.id_or_name(category, "id", "en_name")).select(F.col("id").alias("__cid"))
    bridge = t["product_categories"].join(cats, F.col("category_id") == F.col("__cid"), "inner")
    ids = bridge.select(F.col("product_id").alias("__pid"))
    p = t["products"].where(F.col("status") == "active")
    return p.join(ids, p["id"] == ids["__pid"], "left_semi")


def category_products(t: Tables, category: str, sort_by: str = "created_at", order: str = "DESC",
                      limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q4: page of a category's active products with children."""
    spec = order_spec(sort_by, order, CATEGORY_SORT)
    return product_page(t, category_filter(t, category), spec, limit, offset)


def category_products_count(t: Tables, category: str, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    return page_info(category_filter(t, category), limit, offset)


# ---------------------------------------------------------------- Q9 / Q23
def seller_profiles(t: Tables) -> DataFrame:
    """Q9 for all sellers: seller columns plus owner's first and last name."""
    u = t["users"].select(F.col("id").alias("__uid"), "first_name", "last_name")
    s = t["sellers"]
    return s.join(u, s["user_id"] == u["__uid"], "inner").drop("__uid")


# ---------------------------------------------------------------- Q10 seller products
SELLER_PRODUCT_SORT = ["created_at", "name", "price", "stock", "status"]


def seller_products(t: Tables, status=None, category=None, min_price=None, max_price=None, search=None,
                    sort_by: str = "created_at", order: str = "DESC", limit=10, offset=0,
                    seller_ids: DataFrame | None = None) -> DataFrame:
    """Q10 for every seller at once: each seller's page of products (L7) with
    preview text (X12), categories and images as arrays (empty, not null: A8)
    and the product's order-line count (J9)."""
    limit = P.parse_int(limit, 10)
    offset = P.parse_int(offset, 0, zero_falls_back=False)
    p = _seller_product_filter(t, status, category, min_price, max_price, search, seller_ids)
    spec = order_spec(sort_by, order, SELLER_PRODUCT_SORT, enums={"status": ENUMS["product_status"]})
    paged = page_per_key(p, "seller_id", spec, limit, offset)
    cols = present(paged, ["id", ("name", "title"), "description", "price", "stock", "status", "created_at",
                           "updated_at", "seller_id", "rank_in_key"])
    rows = with_seller(paged.select(*cols), t["sellers"])
    rows = attach_product_children(rows, t, empty="array", image_url_field="url",
                                   with_features=False)
    lines = t["order_items"].join(rows.select(F.col("id").alias("__k")), F.col("product_id") == F.col("__k"), "left_semi")
    rows = A.attach_counts(rows, A.count_by(lines, "product_id", "total_orders"), "id", ["total_orders"])
    return rows.withColumn("description", preview("description"))


def _seller_product_filter(t: Tables, status, category, min_price, max_price, search,
                           seller_ids: DataFrame | None) -> DataFrame:
    lo = None if min_price in (None, "") else P.parse_float(min_price, 0)
    hi = None if max_price in (None, "") else P.parse_float(max_price, 0)
    p = t["products"].where(F.col("seller_id").isNotNull())
    if seller_ids is not None:
        p = p.join(seller_ids.select(F.col("seller_id").alias("__s")), F.col("seller_id") == F.col("__s"), "left_semi")
    p = P.where_all(p, [P.eq_if("status", status), P.between_if("price", lo, hi),
                        P.search(search, ["name", "description"])])
    if category:
        b = t["product_categories"].where(F.col("category_id") == F.lit(category)).select(F.col("product_id").alias("__pid"))
        p = p.join(b, p["id"] == b["__pid"], "left_semi")
    return p


def seller_products_count(t: Tables, status=None, category=None, min_price=None, max_price=None, search=None,
                          limit=10, offset=0, seller_ids: DataFrame | None = None) -> DataFrame:
    """Pagination block of every (asked-for) seller with the filters of ``seller_products`` (A1, L5); a seller
    without a match has the total 0."""
    p = _seller_product_filter(t, status, category, min_price, max_price, search, seller_ids)
    limit = P.parse_int(limit, 10)
    offset = P.parse_int(offset, 0, zero_falls_back=False)
    sellers = t["sellers"].select(F.col("id").alias("seller_id"))
    if seller_ids is not None:
        sellers = sellers.join(seller_ids.select("seller_id").distinct(), "seller_id", "left_semi")
    counts = p.groupBy(F.col("seller_id").alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    total = F.coalesce("__n", F.lit(0).cast("bigint"))
    return sellers.join(counts, F.col("seller_id") == F.col("__k"), "left").select(
        "seller_id", total.alias("total"), F.ceil(total / F.lit(limit)).cast("bigint").alias("total_pages"),
        F.lit(limit).cast("bigint").alias("limit"), F.lit(offset).cast("bigint").alias("offset"))


# ---------------------------------------------------------------- Q12 / Q17
ORDER_COLS = ["id", "user_id", "address_id", "total_amount", "status", "payment_method", "created_at", "updated_at"]


def seller_orders(t: Tables, dedupe: bool = True, seller_ids: DataFrame | None = None) -> DataFrame:
    """Q12 for all sellers: orders containing a seller's product, with buyer
    name and shipping address (J3).

    The seller key comes from ``products.seller_id`` (D8). ``dedupe=True``
    lists each (seller, order) once; ``dedupe=False`` keeps the source's
    fan-out of one row per matching order line (D9). Lines are reduced to
    (seller, order) pairs before the wide order/user/address columns join.
    """
    prod = t["products"].select(F.col("id").alias("__pid"), "seller_id").where(F.col("seller_id").isNotNull())
    if seller_ids is not None:
        prod = prod.join(seller_ids.select(F.col("seller_id").alias("__s")), F.col("seller_id") == F.col("__s"), "left_semi")
    pairs = t["order_items"].select("order_id", "product_id").join(prod, F.col("product_id") == F.col("__pid"), "inner")
    pairs = pairs.select("seller_id", "order_id")
    if dedupe:
        pairs = pairs.distinct()
    o = t["shop_orders"]
    o = o.select(*present(o, ORDER_COLS))
    u = t["users"].select(F.col("id").alias("__uid"), "first_name", "last_name")
    a = t["addresses"].select(F.col("id").alias("__aid"), "address", "city", "province", "postal_code")
    out = pairs.join(o, pairs["order_id"] == o["id"], "inner").drop("order_id")
    out = out.join(u, F.col("user_id") == F.col("__uid"), "inner").drop("__uid")
    return out.join(a, F.col("address_id") == F.col("__aid"), "inner").drop("__aid")


def orders_with_address(t: Tables) -> DataFrame:
    """Q17 for all users: order columns plus address fields."""
    o = t["shop_orders"]
    a = t["addresses"].select(F.col("id").alias("__aid"), "address", "city", "province", "postal_code")
    return o.join(a, o["address_id"] == a["__aid"], "inner").drop("__aid")


# ---------------------------------------------------------------- Q19 / Q22 carts
def main_images(images: DataFrame) -> DataFrame:
    """One main image per product (J11): smallest id among ``is_main`` rows."""
    return N.one_per_key(images.where(F.col("is_main")), "product_id", "id",
                         ["id", "image_url", "is_main"], "main_image")


def cart_lines(t: Tables) -> DataFrame:
    """Q19 item list for all carts: lines joined to product and seller (J4),
    with the product's main image URL (J11) and the line total."""
    ci = t["cart_items"]
    p = t["products"].select(F.col("id").alias("__pid"), F.col("name").alias("product_name"),
                             F.col("description").alias("description"), F.col("stock").alias("available_stock"),
                             F.col("status").alias("product_status"), "seller_id")
    s = t["sellers"].select(F.col("id").alias("__sid"), F.col("shop_name").alias("seller_name"))
    out = (ci.join(p, ci["product_id"] == p["__pid"], "inner")
             .join(s, F.col("seller_id") == F.col("__sid"), "inner")
             .drop("__pid", "__sid", "seller_id"))
    out = N.attach_one(out, main_images(t["product_images"]), "product_id")
    return (out.withColumn("main_image_url", F.col("main_image.image_url")).drop("main_image")
               .withColumnRenamed("price", "price_per_item")
               .withColumn("total_price", F.col("price_per_item") * F.col("quantity").cast("bigint")))


def cart_summary(t: Tables) -> DataFrame:
    """Q19 header for all carts: distinct shop names and totals over the
    listed lines (A12, A13). Carts without listed lines get zeros and []."""
    lines = cart_lines(t)
    agg = (lines.groupBy(F.col("cart_id").alias("__k"))
                .agg(F.array_sort(F.collect_set("seller_name")).alias("sellers"),
                     F.count(F.lit(1)).alias("item_count"),
                     F.sum(F.col("quantity").cast("bigint")).alias("total_items"),
                     F.sum("total_price").alias("total_price")))
    c = t["carts"].select(F.col("id").alias("cart_id"), "user_id")
    out = c.join(agg, c["cart_id"] == agg["__k"], "left").drop("__k")
    return out.select("cart_id", "user_id",
                      F.coalesce("sellers", F.array().cast("array<string>")).alias("sellers"),
                      F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"),
                      F.coalesce("total_items", F.lit(0).cast("bigint")).alias("total_items"),
                      F.coalesce("total_price", F.lit(0).cast("bigint")).alias("total_price"))


def cart_contains(t: Tables, pairs: DataFrame) -> DataFrame:
    """Q22 for a batch of (user_id, product_id): is the product in one of the
    user's carts, and the line with current price, stock and main image."""
    rq = pairs.select(F.col("user_id").alias("rq_user"), F.col("product_id").alias("rq_product")).distinct()
    c = t["carts"].select(F.col("id").alias("__cid"), F.col("user_id").alias("__uid"))
    ci = t["cart_items"].select("cart_id", "product_id", "quantity", F.col("price").alias("cart_price"))
    p = t["products"].select(F.col("id").alias("__pid"), F.col("name").alias("product_name"),
                             F.col("price").alias("current_price"), F.col("stock").alias("available_stock"))
    held = (c.join(ci, c["__cid"] == ci["cart_id"], "inner")
             .join(p, F.col("product_id") == F.col("__pid"), "inner")
             .drop("__cid", "__pid"))
    held = N.attach_one(held, main_images(t["product_images"]), "product_id")
    out = rq.join(held, (rq["rq_user"] == held["__uid"]) & (rq["rq_product"] == held["product_id"]), "left")
    return out.select(F.col("rq_user").alias("user_id"), F.col("rq_product").alias("product_id"),
                      F.col("cart_id").isNotNull().alias("in_cart"), "cart_id", "quantity", "cart_price",
                      "product_name", "current_price", "available_stock",
                      F.col("main_image.image_url").alias("main_image_url"))


# ---------------------------------------------------------------- Q26 blogs
BLOG_SORT = ["created_at", "title", "views", "author_id"]


def blog_listing(t: Tables, category=None, sort_by: str = "created_at", order: str = "DESC",
                 limit: int = DEFAULT_LIMIT, offset: int = 0, per_page: bool = True) -> DataFrame:
    """Q26: page of blogs with author names, preview text, approved-or-not
    comment count, tag names and images (A3, A8, A9, X12, D5)."""
    spec = order_spec(sort_by, order, BLOG_SORT)
    b = P.where_all(t["blogs"], [P.eq_if("category", category)])
    cols = present(b, ["id", "title", "content", "category", "views", "created_at", "updated_at", "author_id"])
    u = t["users"].select(F.col("id").alias("__uid"), F.col("first_name").alias("author_first_name"),
                          F.col("last_name").alias("author_last_name"))
    if per_page:
        rows = found = page_rows(b.select(*cols), spec, limit, offset)
        u = of_page(u, "__uid", found, limit, "author_id")
        keyed = lambda child, fk: of_page(child, fk, found, limit)
    else:
        rows = b.select(*cols)
        keyed = lambda child, fk: child
    rows = rows.join(u, rows["author_id"] == u["__uid"], "left").withColumn("author_id", F.col("__uid")).drop("__uid")
    blog_comments = keyed(t["comments"].where(F.col("parent_type") == "blog"), "parent_id")
    rows = A.attach_counts(rows, A.count_by(blog_comments, "parent_id", "comment_count"), "id", ["comment_count"])
    if "blog_tags" in t:
        rows = N.scalar_list(rows, keyed(t["blog_tags"], "blog_id"), ("id", "blog_id"), "name", "tags", empty="array")
    else:
        rows = rows.withColumn("tags", F.array().cast("array<string>"))
    if "blog_images" in t:
        rows = N.nest(rows, keyed(t["blog_images"], "blog_id"), ("id", "blog_id"), ["id", ("image_url", "url")],
                      "images", empty="array")
    rows = rows.withColumn("content", preview("content"))
    return in_page_order(rows, spec, limit) if per_page else rows.orderBy(*spec)


def blog_count(t: Tables, category=None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q26 pagination block with the page's filter."""
    return page_info(P.where_all(t["blogs"], [P.eq_if("category", category)]), limit, offset)


def blog_details(t: Tables, keys: DataFrame, key_col: str = "id") -> DataFrame:
    """Q27 for a batch of ids: the blogs' columns and whether each id exists."""
    return lookup(t["blogs"], keys, "id", key_col, missing="flag")


def update_blogs(t: Tables, changes: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Q27 update ``(id, title, content, change_ts, seq)``: null keeps (M2), unknown ids are refused.
    Returns {'blogs', 'rejected'}."""
    known = t["blogs"].select(F.col("id").alias("__known"))
    rejected = changes.join(known, changes["id"] == F.col("__known"), "left_anti")
    return {"blogs": M.patch_coalesce(t["blogs"], changes, "id", ["title", "content"], as_of),
            "rejected": rejected.withColumn("reason", F.lit("blog not found"))}


def delete_blogs(t: Tables, keys: DataFrame, fks, tables_for_cascade: list[str]) -> dict[str, DataFrame]:
    """Q27 delete: the blogs of the given ids and what hangs on them (M8); '__unknown' lists ids without a blog."""
    out = M.cascade_delete({n: t[n] for n in tables_for_cascade}, "blogs", keys.select("id").distinct(), fks)
    out["__unknown"] = keys.select("id").distinct().join(t["blogs"].select("id"), "id", "left_anti")
    return out


# ---------------------------------------------------------------- Q28 / Q29 comments
MODERATION_SORT = ["created_at", "updated_at", "status"]


def _comment_filter(t: Tables, status=None, parent_type=None, search=None) -> DataFrame:
    if parent_type:
        P.check_allowed(parent_type.lower(), ["blog", "product"], "parent type")
    c = t["comments"]
    u = t["users"].select(F.col("id").alias("__uid"), F.col("first_name").alias("u_first_name"),
                          F.col("last_name").alias("u_last_name"), F.col("email").alias("u_email"),
                          *([F.col("profile_image_url").alias("u_profile_image_url")]
                            if "profile_image_url" in t["users"].columns else []))
    j = c.join(u, c["user_id"] == u["__uid"], "left")
    return P.where_all(j, [P.eq_if("status", status),
                           P.eq_if("parent_type", parent_type.lower() if parent_type else None),
                           P.search(search, ["content", "u_first_name", "u_last_name", "u_email"])])


def moderation_list(t: Tables, status=None, parent_type=None, search=None, sort_by: str = "created_at",
                    order: str = "DESC", limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q28: filtered page of all comments with the author object and the
    polymorphic parent object (J12); sorting by status follows enum order."""
    spec = order_spec(sort_by, order, MODERATION_SORT, enums={"status": ENUMS["comment_status"]})
    kept = _comment_filter(t, status, parent_type, search).select(*[t["comments"][x] for x in t["comments"].columns])
    c = page_rows(kept, spec, limit, offset)
    # From here on only the users and parents that the page's comments name are read.
    cols = present(c, ["id", "content", "rating", "status", "parent_type", "parent_id", "created_at", "updated_at"])
    ucols = [F.col("id").alias("__uid"), F.col("first_name").alias("u_first_name"),
             F.col("last_name").alias("u_last_name"), F.col("email").alias("u_email")]
    if "profile_image_url" in t["users"].columns:
        ucols.append(F.col("profile_image_url").alias("u_profile_image_url"))
    u = of_page(t["users"].select(*ucols), "__uid", c, limit, "user_id")
    j = c.join(u, c["user_id"] == u["__uid"], "left")
    user = [F.col("__uid").alias("id"), F.col("u_first_name").alias("first_name"),
            F.col("u_last_name").alias("last_name"), F.col("u_email").alias("email")]
    if "u_profile_image_url" in j.columns:
        user.append(F.col("u_profile_image_url").alias("profile_image_url"))
    rows = j.select(*cols, F.struct(*user).alias("user"))
    prods = of_page(t["products"], "id", c.where(F.col("parent_type") == "product"), limit, "parent_id")
    blogs = of_page(t["blogs"], "id", c.where(F.col("parent_type") == "blog"), limit, "parent_id")
    rows = N.polymorphic_parent(rows, "parent_type", "parent_id",
                                {"product": (prods, "id", {"name": "name"}),
                                 "blog": (blogs, "id", {"title": "title"})}, "parent_item")
    return in_page_order(rows, spec, limit)


def moderation_count(t: Tables, status=None, parent_type=None, search=None, limit=DEFAULT_LIMIT, offset=0):
    return page_info(_comment_filter(t, status, parent_type, search), limit, offset)


def public_comments(t: Tables, viewer_role: str | None = None, status: str | None = None,
                    limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q29 for every parent at once: each (parent_type, parent_id)'s page of
    visible comments, newest first (F7, L7), with author columns (J2)."""
    c = P.visible_comments(t["comments"], viewer_role, status)
    spec = order_spec("created_at", "DESC")
    paged = page_per_key(c, ["parent_type", "parent_id"], spec, limit, offset)
    cols = present(paged, ["id", "parent_type", "parent_id", "content", "rating", "status", "created_at",
                           "updated_at", "user_id", "rank_in_key"])
    paged = paged.select(*cols)
    ucols = [F.col("id").alias("__uid"), "first_name", "last_name"]
    if "profile_image_url" in t["users"].columns:
        ucols.append("profile_image_url")
    u = t["users"].select(*ucols)
    return paged.join(u, paged["user_id"] == u["__uid"], "left").withColumn("user_id", F.col("__uid")).drop("__uid")


def public_comments_count(t: Tables, viewer_role: str | None = None, status: str | None = None,
                          limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q29 pagination block of every parent that has visible comments."""
    n = F.count(F.lit(1))
    return (P.visible_comments(t["comments"], viewer_role, status).groupBy("parent_type", "parent_id")
             .agg(n.alias("total"), F.ceil(n / F.lit(limit)).cast("bigint").alias("total_pages"))
             .withColumns({"limit": F.lit(limit).cast("bigint"), "offset": F.lit(offset).cast("bigint")}))


# ---------------------------------------------------------------- Q31 / Q33 / Q35 users
def seller_of_user(sellers: DataFrame) -> DataFrame:
    """One seller struct per user (J10); several rows per user keep the smallest id."""
    return N.one_per_key(sellers.where(F.col("user_id").isNotNull()), "user_id", "id",
                         ["id", "shop_name", "status", "rating"], "seller_info")


USER_PUBLIC = ["id", "first_name", "last_name", "email", "phone_number", "home_address", "home_phone_number",
               "role", "profile_image_url", "is_verified", "created_at", "updated_at"]


def users_with_seller(t: Tables, keys: DataFrame | None = None) -> DataFrame:
    """Q31 for all (or a batch of) users: public columns (no password hash, F1)
    plus the seller object for users whose role is seller."""
    u = t["users"]
    if keys is not None:
        u = lookup(u, keys, "id", "id", missing="drop")
    u = u.select(*present(u, USER_PUBLIC))
    out = N.attach_one(u, seller_of_user(t["sellers"]), "id")
    return out.withColumn("seller", F.when(F.col("role") == "seller", F.col("seller_info"))).drop("seller_info")


def addresses_ordered(t: Tables) -> DataFrame:
    """Q33 for all users: addresses in (user, default first, newest first) order.

    A global sort is range-partitioned on all the sort keys, so one user
    with very many addresses is split across tasks (no per-user window)."""
    return t["addresses"].orderBy(F.col("user_id").asc(), *multi_order(("is_default", "DESC"), ("created_at", "DESC")))


USER_SORT = ["created_at", "first_name", "last_name", "email", "role", "is_verified"]


def user_filter(t: Tables, role=None, is_verified=None, search=None) -> DataFrame:
    flag = P.parse_flag(is_verified)
    return P.where_all(t["users"], [P.eq_if("role", role),
                                    None if flag is None else (F.col("is_verified") == F.lit(flag)),
                                    P.search(search, ["first_name", "last_name", "email", "phone_number"])])


def user_listing(t: Tables, role=None, is_verified=None, search=None, sort_by: str = "created_at",
                 order: str = "DESC", limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Q35: page of users with seller object (J10) and order count."""
    spec = order_spec(sort_by, order, USER_SORT, enums={"role": ENUMS["user_role"]})
    u = user_filter(t, role, is_verified, search)
    u = u.select(*present(u, ["id", "first_name", "last_name", "email", "phone_number", "role", "is_verified",
                              "created_at", "updated_at"]))
    found = page_rows(u, spec, limit, offset)
    rows = N.attach_one(found, seller_of_user(of_page(t["sellers"], "user_id", found, limit)), "id")
    orders = of_page(t["shop_orders"], "user_id", found, limit)
    rows = A.attach_counts(rows, A.count_by(orders, "user_id", "total_orders"), "id", ["total_orders"])
    return in_page_order(rows, spec, limit)


def user_count(t: Tables, role=None, is_verified=None, search=None, limit=DEFAULT_LIMIT, offset=0):
    return page_info(user_filter(t, role, is_verified, search), limit, offset)


# ---------------------------------------------------------------- Q6 / Q7 product writes
def product_owners(t: Tables) -> DataFrame:
    """(product id, owner user id) through the product's seller."""
    p, s = t["products"], t["sellers"]
    return p.join(s.select(F.col("id").alias("__sid"), F.col("user_id").alias("owner_id")),
                  p["seller_id"] == F.col("__sid")).select(p["id"], "owner_id")


def authorize(requests: DataFrame, owners: DataFrame, id_col: str = "id", requester_col: str = "requester_id",
              admin_col: str | None = "is_admin") -> tuple[DataFrame, DataFrame]:
    """Split requests into (allowed, refused): the requester owns the row, or is
    an admin (the source lets an admin update any existing product)."""
    o = owners.select(F.col("id").alias("__oid"), F.col("owner_id").alias("__owner"))
    r = requests.join(o, (requests[id_col] == o["__oid"]) & (requests[requester_col] == o["__owner"]), "left")
    ok = F.col("__oid").isNotNull()
    if admin_col and admin_col in requests.columns:
        ok = ok | F.coalesce(F.col(admin_col), F.lit(False))
    r = r.withColumn("__ok", ok)
    return (r.where(F.col("__ok")).select(*requests.columns),
            r.where(~F.col("__ok")).select(*requests.columns).withColumn("reason", F.lit("not found or not owner")))


PRODUCT_PATCH_FIELDS = ["name", "price", "description", "stock", "status"]


def update_products(t: Tables, patches: DataFrame, category_lists: DataFrame | None = None,
                    feature_lists: DataFrame | None = None, as_of=None) -> dict[str, DataFrame]:
    """Q6 for a batch: authorized patches (M3, presence mask) touch ``updated_at``
    (M15); products whose request carries a category or feature list get
    those children replaced (M6), an empty list clearing them. List frames
    are flat: (product_id, change_ts, seq, child columns...), one row per
    element, and one row with null child columns for an empty list.
    Returns {'products', 'product_categories', 'product_features', 'rejected'}."""
    ok, refused = authorize(patches, product_owners(t))
    exists = t["products"].select(F.col("id").alias("__e"))
    ok = ok.join(exists, ok["id"] == exists["__e"], "left_semi")
    fields = [f for f in PRODUCT_PATCH_FIELDS if f in t["products"].columns and f in patches.columns]
    products = M.patch_present(t["products"], ok, "id", fields, as_of)
    out = {"products": products, "rejected": refused}
    allowed = ok.select(F.col("id").alias("product_id"), "change_ts", "seq")
    for name, lists, table in (("product_categories", category_lists, "product_categories"),
                               ("product_features", feature_lists, "product_features")):
        if lists is None:
            out[name] = t[table]
            continue
        mine = lists.join(allowed, ["product_id", "change_ts", "seq"], "left_semi")
        # the last request per product that carries a list decides the new children
        last = mine.groupBy("product_id").agg(F.max(F.struct("change_ts", "seq")).alias("__last"))
        chosen = mine.join(last, "product_id").where(F.struct("change_ts", "seq") == F.col("__last"))
        touched = last.select("product_id")
        child_cols = [c for c in lists.columns if c not in ("product_id", "change_ts", "seq")]
        present_row = F.greatest(*[F.col(c).isNotNull() for c in child_cols]) if len(child_cols) > 1 \
            else F.col(child_cols[0]).isNotNull()
        new_rows = chosen.where(present_row).select("product_id", *child_cols)
        out[name] = M.replace_children(t[table], new_rows, "product_id", touched)
    return out


def delete_products(t: Tables, requests: DataFrame, fks, tables_for_cascade: list[str]) -> dict[str, DataFrame]:
    """Q7 for a batch: owners' delete requests (M7) cascade over the FK list
    (M8); products with order lines are refused (RESTRICT).
    Returns the new tables plus 'refused' (id, reason)."""
    ok, refused = authorize(requests, product_owners(t), admin_col=None)
    tabs = {n: t[n] for n in tables_for_cascade}
    res = M.cascade_delete(tabs, "products", ok.select("id").distinct(), fks)
    refused = refused.select("id", "reason").unionByName(
        res["__rejected"].select(F.col("root").alias("id"), "reason"))
    res["refused"] = refused
    return res


# ---------------------------------------------------------------- A11 / A16 / M9 categories
def category_delete(t: Tables, category_ids: DataFrame) -> dict[str, DataFrame]:
    """Q25 for a batch of category ids (M9).

    A category is refused while some product has it as its *only* category
    (A11). Accepted ids are removed from categories and from the bridge.
    Returns {'refused', 'blocking', 'categories', 'product_categories'}:
    'refused' holds the number of blocking products of each category,
    'blocking' the products as rows (category_id, product_id, name); their
    names as one text (A16) are for chosen categories, see ``blocking_names``.
    """
    req = category_ids.select(F.col("id").alias("cat")).distinct()
    only = A.single_category_products(t["product_categories"])
    blocking = (only.join(req, only["category_id"] == req["cat"], "left_semi")
                    .join(t["products"].select(F.col("id").alias("__pid"), "name"),
                          F.col("product_id") == F.col("__pid"), "inner"))
    refused = blocking.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_blocking"))
    accepted = req.join(refused, req["cat"] == refused["category_id"], "left_anti")
    cats = t["categories"].join(accepted, t["categories"]["id"] == accepted["cat"], "left_anti")
    bridge = t["product_categories"].join(accepted, F.col("category_id") == accepted["cat"], "left_anti")
    return {"refused": refused, "blocking": blocking.select("category_id", "product_id", "name"),
            "categories": cats, "product_categories": bridge}


def blocking_names(blocking: DataFrame, category_ids: DataFrame) -> DataFrame:
    """(category_id, blocking_products), the sorted names as one text, for the asked categories only (the text of
    a category stands in one row, so ask for those that are shown)."""
    asked = category_ids.select(F.col("id").alias("__c")).distinct()
    return (blocking.join(asked, F.col("category_id") == F.col("__c"), "left_semi").groupBy("category_id")
            .agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("blocking_products")))
