"""Hand-made edge frames (FIXTURES §4): nulls, ties, empty children, duplicates,
boundaries — cases the supplied tables never contain."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopframe.functions import predicates as P
from shopframe.functions.ordering import order_spec
from shopframe.functions.text import preview
from shopframe.operators import audit as C
from shopframe.operators import changes as M
from shopframe.operators import metrics as A
from shopframe.operators import nest as N
from shopframe.operators import windows as Wn
from shopframe.operators.paging import page, page_info, page_per_key
from shopframe.schemas import ENUMS

T0 = dt.datetime(2024, 1, 20, 0, 0, 0)


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


# ---------------------------------------------------------------- L1 / L6
def test_null_sort_keys_follow_source_placement(spark):
    df = spark.createDataFrame([(1, None), (2, Decimal("4.50")), (3, Decimal("1.00"))], "id int, rating decimal(3,2)")
    assert ids(df.orderBy(*order_spec("rating", "DESC"))) == [1, 2, 3]
    assert ids(df.orderBy(*order_spec("rating", "asc"))) == [3, 2, 1]


def test_enum_order_is_declaration_order(spark):
    df = spark.createDataFrame([(1, "rejected"), (2, "approved"), (3, "pending")], "id int, status string")
    spec = order_spec("status", "ASC", enums={"status": ENUMS["comment_status"]})
    assert ids(df.orderBy(*spec)) == [3, 2, 1]
    users = spark.createDataFrame([(1, "customer"), (2, "admin"), (3, "seller")], "id int, role string")
    spec = order_spec("role", "ASC", enums={"role": ENUMS["user_role"]})
    assert ids(users.orderBy(*spec)) == [2, 3, 1]


def test_bad_sort_field_is_refused():
    with pytest.raises(ValueError):
        order_spec("password_hash", "ASC", allowed=["created_at"])
    with pytest.raises(ValueError):
        order_spec("created_at", "sideways")


def test_page_and_page_info(spark):
    df = spark.range(25).withColumnRenamed("id", "k").withColumn("id", F.col("k"))
    rows = ids(page(df, order_spec("k", "ASC"), limit=10, offset=20))
    assert rows == [20, 21, 22, 23, 24]
    info = page_info(df, 10, 20).first()
    assert (info.total, info.total_pages, info.current_page) == (25, 3, 3)


def test_keyset_page_walks_the_same_order_as_offsets(spark):
    from shopframe.operators.paging import keyset_page
    rows = [(i, (i * 7) % 5) for i in range(23)]  # many ties on the sort column
    df = spark.createDataFrame(rows, "id int, v int")
    spec = order_spec("v", "DESC")
    by_offset = [ids(page(df, spec, limit=5, offset=o)) for o in range(0, 23, 5)]
    walked, last = [], None
    for _ in range(5):
        pg = (page(df, spec, limit=5) if last is None else keyset_page(df, "v", "DESC", last[1], last[0], 5)).collect()
        walked.append([r.id for r in pg])
        if pg:
            last = (pg[-1].id, pg[-1].v)
    assert walked == by_offset


def test_page_per_key_keeps_window_of_each_key(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", "b") for i in range(7)], "key string, id int")
    out = page_per_key(df, "key", [F.col("id").desc()], limit=3, offset=2).collect()
    got = sorted((r.key, r.id) for r in out)
    assert got == [("a", 2), ("a", 3), ("a", 4), ("b", 2), ("b", 3), ("b", 4)]


# ---------------------------------------------------------------- A7 / A8 / J10 / J11 / J12
def test_childless_parent_null_vs_empty(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(10, 1, "u")], "id int, product_id int, image_url string")
    a7 = {r.id: r.images for r in N.nest(parents, kids, ("id", "product_id"), ["id", "image_url"], "images").collect()}
    a8 = {r.id: r.images for r in N.nest(parents, kids, ("id", "product_id"), ["id", "image_url"], "images",
                                         empty="array").collect()}
    assert a7[2] is None and a8[2] == []
    assert [x.id for x in a7[1]] == [10]


def test_nest_many_keeps_null_vs_empty_per_collection(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    imgs = spark.createDataFrame([(10, 1, "u"), (11, 1, "v"), (12, 2, "w")], "id int, product_id int, url string")
    cats = spark.createDataFrame([(1, "c")], "product_id int, cid string")
    specs = [(imgs, "product_id", ["id", "url"], "images"), (cats, "product_id", ["cid"], "categories")]
    a7 = {r.id: (r.images, r.categories) for r in N.nest_many(parents, "id", specs).collect()}
    assert [x.id for x in a7[1][0]] == [10, 11] and a7[1][1][0].cid == "c"
    assert [x.id for x in a7[2][0]] == [12] and a7[2][1] is None
    assert a7[3] == (None, None)
    a8 = {r.id: (r.images, r.categories) for r in N.nest_many(parents, "id", specs, empty="array").collect()}
    assert a8[2][1] == [] and a8[3] == ([], [])


def test_nest_then_explode_gives_child_rows(spark):
    parents = spark.createDataFrame([(i,) for i in range(5)], "id int")
    kids = spark.createDataFrame([(j, j % 3) for j in range(20)], "id int, product_id int")
    nested = N.nest(parents, kids, ("id", "product_id"), ["id"], "c")
    back = nested.select("id", F.explode("c").alias("x")).select(F.col("x.id").alias("cid"), F.col("id").alias("pid"))
    assert sorted(map(tuple, back.collect())) == sorted((j, j % 3) for j in range(20))


def test_several_seller_rows_for_one_user_keep_smallest(spark):
    sellers = spark.createDataFrame([(7, 1, "B", "active", Decimal("1.00")), (3, 1, "A", "pending", None)],
                                    "id int, user_id int, shop_name string, status string, rating decimal(3,2)")
    one = N.one_per_key(sellers, "user_id", "id", ["id", "shop_name"], "s").collect()
    assert len(one) == 1 and one[0].s.id == 3


def test_polymorphic_parent(spark):
    comments = spark.createDataFrame([(1, "product", 5), (2, "blog", 5), (3, "blog", 9)],
                                     "id int, parent_type string, parent_id int")
    products = spark.createDataFrame([(5, "P5")], "id int, name string")
    blogs = spark.createDataFrame([(5, "B5")], "id int, title string")
    out = {r.id: r.parent for r in N.polymorphic_parent(
        comments, "parent_type", "parent_id",
        {"product": (products, "id", {"name": "name"}), "blog": (blogs, "id", {"title": "title"})}, "parent").collect()}
    assert out[1].name == "P5" and out[1].title is None
    assert out[2].title == "B5" and out[2].name is None
    assert out[3] is None


# ---------------------------------------------------------------- A6
def test_rating_rounding_is_exact(spark):
    rows = [("product", 1, 3, "approved")] * 13301 + [("product", 1, 4, "approved")] * 6699
    df = spark.createDataFrame(rows, "parent_type string, parent_id int, rating int, status string")
    r = A.ratings(df).first()
    assert r.average_rating == Decimal("3.33") and r.n_ratings == 20000


def test_half_rounds_up(spark):
    rows = [("blog", 1, 3, "approved")] * 333 + [("blog", 1, 4, "approved")] * 667 + [("blog", 1, 5, "pending")]
    df = spark.createDataFrame(rows, "parent_type string, parent_id int, rating int, status string")
    assert A.ratings(df).first().average_rating == Decimal("3.67")
    two = spark.createDataFrame([("blog", 2, 3, "approved"), ("blog", 2, 4, "approved")] * 1 +
                                [("blog", 2, 3, "approved")] * 0, "parent_type string, parent_id int, rating int, status string")
    assert A.ratings(two).first().average_rating == Decimal("3.50")


def test_no_approved_rating_writes_zero(spark):
    comments = spark.createDataFrame([("product", 1, 5, "pending")], "parent_type string, parent_id int, rating int, status string")
    parents = spark.createDataFrame([(1, Decimal("4.00"))], "id int, average_rating decimal(3,2)")
    out = A.write_back_ratings(parents, comments, "product").first()
    assert out.average_rating == Decimal("0.00")


# ---------------------------------------------------------------- F5 / F6 / X12 / X14
def test_wildcards_are_kept_unless_escaped(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "50x off")], "id int, name string")
    assert sorted(ids(df.where(P.search("50%", ["name"])))) == [1, 2]
    assert ids(df.where(P.search("50%", ["name"], escape=True))) == [1]
    assert sorted(ids(df.where(P.search("OFF", ["name"])))) == [1, 2]


def test_flag_and_number_parsing():
    assert P.parse_flag("true") is True and P.parse_flag("yes") is False and P.parse_flag(None) is None
    assert P.parse_int("abc", 10) == 10 and P.parse_int("0", 10) == 10 and P.parse_int("25x", 10) == 25
    assert P.parse_float("x", 0) == 0 and P.parse_float("12.5kg", 0) == 12.5


def test_preview(spark):
    df = spark.createDataFrame([("a" * 200,), ("b" * 201,), (None,)], "t string")
    out = [r.p for r in df.select(preview("t").alias("p")).collect()]
    assert out[0] == "a" * 200 and out[1] == "b" * 200 + "..." and out[2] is None


# ---------------------------------------------------------------- M2 / M3 / batches
def _users(spark):
    return spark.createDataFrame([(1, "Ann", "Lee", "a@x.io")], "id int, first_name string, last_name string, email string")


def test_patch_null_keeps_vs_presence_mask_clears(spark):
    ch = spark.createDataFrame([(1, None, "Kim", T0, 1)], "id int, first_name string, last_name string, change_ts timestamp, seq int")
    kept = M.patch_coalesce(_users(spark), ch, "id", ["first_name", "last_name"]).first()
    assert (kept.first_name, kept.last_name) == ("Ann", "Kim")
    chp = ch.withColumn("present", F.array(F.lit("first_name")))
    cleared = M.patch_present(_users(spark), chp, "id", ["first_name", "last_name"]).first()
    assert (cleared.first_name, cleared.last_name) == (None, "Lee")


def test_touch_sets_updated_at_on_changed_rows_only(spark):
    base = spark.createDataFrame([(1, "Ann", dt.datetime(2023, 1, 1)), (2, "Bob", dt.datetime(2023, 1, 1))],
                                 "id int, first_name string, updated_at timestamp")
    ch = spark.createDataFrame([(1, "Anna", T0, 1), (3, "Zed", T0, 2)],
                               "id int, first_name string, change_ts timestamp, seq int")
    out = {r.id: (r.first_name, r.updated_at) for r in
           M.patch_coalesce(base, ch, "id", ["first_name"], as_of="2024-01-20 00:00:00").collect()}
    assert out == {1: ("Anna", T0), 2: ("Bob", dt.datetime(2023, 1, 1))}


def test_two_changes_same_key_last_wins(spark):
    ch = spark.createDataFrame([(1, "One", T0, 1), (1, "Two", T0, 2)], "id int, first_name string, change_ts timestamp, seq int")
    assert M.patch_coalesce(_users(spark), ch, "id", ["first_name"]).first().first_name == "Two"
    ch2 = spark.createDataFrame([(1, "One", "X", T0, 1), (1, "Two", None, T0, 2)],
                                "id int, first_name string, last_name string, change_ts timestamp, seq int")
    r = M.patch_coalesce(_users(spark), ch2, "id", ["first_name", "last_name"]).first()
    assert (r.first_name, r.last_name) == ("Two", "X")


def test_over_stock_is_refused(spark):
    carts = spark.createDataFrame([(100, 1)], "id bigint, user_id bigint")
    items = spark.createDataFrame([], "cart_id bigint, product_id bigint, quantity int, price bigint, created_at timestamp")
    products = spark.createDataFrame([(5, 900, 3)], "id bigint, price bigint, stock int")
    ch = spark.createDataFrame([(1, 5, 4, T0, 1), (1, 5, 3, T0, 2), (1, 6, 1, T0, 3)],
                               "user_id bigint, product_id bigint, quantity int, change_ts timestamp, seq int")
    res = M.upsert_cart(carts, items, products, ch)
    rej = sorted((r.seq, r.reason) for r in res["rejected"].collect())
    assert rej == [(1, "not enough stock"), (3, "product not found")]
    lines = [(r.cart_id, r.product_id, r.quantity, r.price) for r in res["cart_items"].collect()]
    assert lines == [(100, 5, 3, 900)]


def test_upsert_replaces_quantity_and_refreshes_price(spark):
    carts = spark.createDataFrame([(100, 1)], "id bigint, user_id bigint")
    items = spark.createDataFrame([(100, 5, 2, 800, T0)], "cart_id bigint, product_id bigint, quantity int, price bigint, created_at timestamp")
    products = spark.createDataFrame([(5, 900, 30)], "id bigint, price bigint, stock int")
    ch = spark.createDataFrame([(1, 5, 7, T0, 1), (2, 5, 1, T0, 2)],
                               "user_id bigint, product_id bigint, quantity int, change_ts timestamp, seq int")
    res = M.upsert_cart(carts, items, products, ch)
    got = sorted((r.cart_id == 100, r.product_id, r.quantity, r.price) for r in res["cart_items"].collect())
    assert got == [(False, 5, 1, 900), (True, 5, 7, 900)]
    assert res["carts"].count() == 2  # user 2 got a cart


def test_replace_children_is_idempotent(spark):
    child = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z")], "product_id int, name string, value string")
    new = spark.createDataFrame([(1, "n", "v")], "product_id int, name string, value string")
    once = M.replace_children(child, new, "product_id")
    twice = M.replace_children(once, new, "product_id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "n", "v"), (2, "c", "z")]


# ---------------------------------------------------------------- A11 / M9
def test_only_category_blocks_delete(spark):
    bridge = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B")], "product_id int, category_id string")
    only = sorted(map(tuple, A.single_category_products(bridge).collect()))
    assert only == [("A", 1)]
    from shopframe.plans.reports import blocking_names, category_delete
    t = {"product_categories": bridge,
         "categories": spark.createDataFrame([("A",), ("B",)], "id string"),
         "products": spark.createDataFrame([(1, "p1"), (2, "p2")], "id int, name string")}
    res = category_delete(t, spark.createDataFrame([("A",), ("B",)], "id string"))
    assert [(r.category_id, r.n_blocking) for r in res["refused"].collect()] == [("A", 1)]
    asked = spark.createDataFrame([("A",)], "id string")
    assert [r.blocking_products for r in blocking_names(res["blocking"], asked).collect()] == ["p1"]
    assert ids(res["categories"]) == ["A"]
    assert sorted(map(tuple, res["product_categories"].collect())) == [(1, "A"), (2, "A")]


# ---------------------------------------------------------------- W2 / W3 / W4 / W5 / F9 / M14
def test_trailing_count_boundary_is_strict(spark):
    rows = [(1, 1, T0 - dt.timedelta(hours=1)), (2, 1, T0 - dt.timedelta(minutes=30)), (3, 1, T0)]
    df = spark.createDataFrame(rows, "id int, user_id int, created_at timestamp")
    got = {r.id: r.n_in_window for r in Wn.trailing_count(df, "user_id", "created_at", 3600, limit=3).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_trailing_count_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.randint(1, 3), T0 + dt.timedelta(seconds=rnd.randint(0, 4 * 3600))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, user_id int, created_at timestamp")
    got = {r.id: r.n_in_window for r in Wn.trailing_count(df, "user_id", "created_at", 3600).collect()}
    for i, u, t in rows:
        want = sum(1 for _, u2, t2 in rows if u2 == u and t - dt.timedelta(hours=1) < t2 <= t)
        assert got[i] == want


def test_live_and_purge_boundaries(spark):
    df = spark.createDataFrame([(1, T0, False), (2, T0 + dt.timedelta(seconds=1), False), (3, T0 + dt.timedelta(days=1), True)],
                               "id int, expires_at timestamp, is_revoked boolean")
    assert ids(P.live(df, "2024-01-20 00:00:00", revoked_col="is_revoked")) == [2]
    assert sorted(ids(M.purge_tokens(df, "2024-01-20 00:00:00"))) == [1, 2]


def test_token_rotation_first_live_presentation_wins(spark):
    later = T0 + dt.timedelta(days=3)
    tokens = spark.createDataFrame([(1, 7, "t1", later, False, T0), (2, 7, "t2", later, False, T0),
                                    (3, 8, "t3", T0, False, T0)],
                                   "id bigint, user_id bigint, token string, expires_at timestamp, is_revoked boolean, "
                                   "created_at timestamp")
    pres = spark.createDataFrame([("t2", T0, 1), ("t1", T0, 2), ("t3", T0, 3), ("zz", T0, 4)],
                                 "token string, change_ts timestamp, seq int")
    res = M.rotate_tokens(tokens, pres, "2024-01-20 00:00:00")
    assert sorted(r.seq for r in res["rejected"].collect()) == [2, 3, 4]  # t1 deleted by the rotation, t3 expired
    left = res["tokens"].collect()
    assert sorted(r.user_id for r in left) == [7, 8] and all(r.token != "t1" and r.token != "t2" for r in left)


def test_main_image_promotion(spark):
    imgs = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 10, False), (4, 20, True)],
                                 "id int, product_id int, is_main boolean")
    out = {r.id: r.is_main for r in Wn.promote_main_after_delete(imgs, spark.createDataFrame([(1,), (4,)], "id int")).collect()}
    assert out == {2: True, 3: False}
    assert C.at_most_one_flag(Wn.promote_main_after_delete(imgs, spark.createDataFrame([(1,)], "id int")),
                              "product_images", "product_id", "is_main").count() == 0


def test_first_upload_flag(spark):
    imgs = spark.createDataFrame([(1, 20, True)], "id int, product_id int, is_main boolean")
    ups = spark.createDataFrame([(10, "a", T0, 2), (10, "b", T0, 1), (20, "c", T0, 1)],
                                "product_id int, image_url string, change_ts timestamp, seq int")
    got = {r.image_url: r.is_main for r in Wn.flag_first_uploads(imgs, ups).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_default_switch_keeps_one_flag(spark):
    addrs = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 7, False), (4, 8, True)],
                                  "id int, user_id int, is_default boolean")
    reqs = spark.createDataFrame([(7, 2, T0, 1), (7, 3, T0, 2), (8, 99, T0, 1)], "user_id int, id int, change_ts timestamp, seq int")
    out = Wn.apply_exclusive_flag(addrs, reqs)
    assert {r.id: r.is_default for r in out.collect()} == {1: False, 2: False, 3: True, 4: True}
    assert C.at_most_one_flag(out, "addresses", "user_id", "is_default").count() == 0


def test_address_update_default_follows_serial_order(spark):
    addrs = spark.createDataFrame([(1, 7, "a", True), (2, 7, "b", False), (3, 7, "c", False), (4, 8, "d", True)],
                                  "id int, user_id int, address string, is_default boolean")
    ch = spark.createDataFrame([(2, 7, None, True, T0, 1), (3, 7, "c2", False, T0, 2),   # 2 becomes default
                                (4, 8, None, True, T0, 1), (4, 8, None, False, T0, 2),   # 4 set, then cleared
                                (1, 8, "x", True, T0, 3)],                                # not user 8's address
                               "id int, user_id int, address string, is_default boolean, change_ts timestamp, seq int")
    res = M.update_addresses(addrs, ch, ["address"])
    got = {r.id: (r.address, r.is_default) for r in res["addresses"].collect()}
    assert got == {1: ("a", False), 2: ("b", True), 3: ("c2", False), 4: ("d", False)}
    assert [r.seq for r in res["rejected"].collect()] == [3]


# ---------------------------------------------------------------- M8 / C2 / C3
def test_cascade_refuses_restricted_root(spark):
    fks = [("products", "seller_id", "sellers", "cascade"), ("order_items", "product_id", "products", "restrict"),
           ("product_images", "product_id", "products", "cascade")]
    t = {"sellers": spark.createDataFrame([(1,), (2,)], "id int"),
         "products": spark.createDataFrame([(10, 1), (20, 2)], "id int, seller_id int"),
         "order_items": spark.createDataFrame([(100, 10)], "order_id int, product_id int"),
         "product_images": spark.createDataFrame([(5, 10), (6, 20)], "id int, product_id int")}
    out = M.cascade_delete(t, "sellers", spark.createDataFrame([(1,), (2,)], "id int"), fks)
    assert [r.root for r in out["__rejected"].collect()] == [1]
    assert ids(out["sellers"]) == [1] and ids(out["products"]) == [10] and ids(out["product_images"]) == [5]
    assert C.orphans(out["products"], "products", "seller_id", out["sellers"]).count() == 0


def test_orphan_comment(spark):
    comments = spark.createDataFrame([(1, "blog", 99), (2, "product", 5)], "id int, parent_type string, parent_id int")
    v = C.polymorphic_orphans(comments, {"blog": (spark.createDataFrame([(1,)], "id int"), "id"),
                                         "product": (spark.createDataFrame([(5,)], "id int"), "id")})
    assert [(r.key, r.column) for r in v.collect()] == [("1", "parent_type:blog")]


def test_rule_runner_reports_every_violation(spark):
    df = spark.createDataFrame([(1, "A", "bad", "0912345678"), (2, "Ann", "a@b.co", "09123456789")],
                               "rid int, first_name string, email string, phone_number string")
    rules = [C.length_rule("first_name", 2, 50), C.pattern_rule("email", C.EMAIL_PATTERN, "email"),
             C.pattern_rule("phone_number", C.MOBILE_PATTERN, "mobile")]
    valid, viol = C.validate(df, rules, "rid")
    assert ids(valid, "rid") == [2]
    assert sorted(r.rule for r in viol.collect()) == ["email", "length", "mobile"]


# ---------------------------------------------------------------- Q11 renames in serial order
def _serial_renames(base, changes):
    names = dict(base)
    rejected = []
    for k, n, seq in sorted(changes, key=lambda c: c[2]):
        if k not in names:
            rejected.append((seq, "not found"))
            continue
        target = n if n is not None else names[k]
        holder = [h for h, v in names.items() if v == target and h != k]
        if holder:
            rejected.append((seq, "name already in use"))
        else:
            names[k] = target
    return names, sorted(rejected)


def test_renames_follow_serial_order_with_freed_names(spark):
    base = [(1, "A"), (2, "B"), (3, "C")]
    changes = [(2, "D", 1),    # B is freed
               (1, "B", 2),    # takes the freed name
               (3, "A", 3),    # A was freed by change 2
               (2, "C", 4),    # C was freed by change 3
               (1, "C", 5),    # taken by row 2 now
               (9, "Z", 6),    # no such row
               (3, None, 7)]   # keeps its name
    b = spark.createDataFrame(base, "id int, shop_name string")
    ch = spark.createDataFrame([(k, n, T0, s) for k, n, s in changes],
                               "id int, shop_name string, change_ts timestamp, seq int")
    res = M.rename_unique(b, ch, "id", ["shop_name"])
    got = {r.id: r.shop_name for r in res["base"].collect()}
    want, want_rej = _serial_renames(base, changes)
    assert got == want == {1: "B", 2: "C", 3: "A"}
    assert sorted((r.seq, r.reason) for r in res["rejected"].collect()) == want_rej


def test_profile_patch_reuses_freed_email_and_resets_verification(spark):
    users = spark.createDataFrame([(1, "a@x.io", "09000000001", True), (2, "b@x.io", "09000000002", True),
                                   (3, "c@x.io", "09000000003", True)],
                                  "id int, email string, phone_number string, is_verified boolean")
    ch = spark.createDataFrame([(1, "b@x.io", None, T0, 1),    # b@ still held by 2: refused
                                (2, "z@x.io", None, T0, 2),    # 2 frees b@
                                (1, "b@x.io", None, T0, 3),    # now accepted
                                (3, "c@x.io", "09000000002", T0, 4)],  # same email; phone held by 2: refused
                               "id int, email string, phone_number string, change_ts timestamp, seq int")
    out, rej = M.patch_user(users, ch, ["email", "phone_number"])
    got = {r.id: (r.email, r.is_verified) for r in out.collect()}
    assert got == {1: ("b@x.io", False), 2: ("z@x.io", False), 3: ("c@x.io", True)}
    assert sorted((r.seq, r.reason) for r in rej.collect()) == [(1, "email in use"), (4, "phone_number in use")]


# ---------------------------------------------------------------- M17 serial equivalence
def test_seller_promotion_equals_serial_order(spark):
    users = spark.createDataFrame([(1, "customer"), (2, "customer"), (3, "customer")], "id int, role string")
    sellers = spark.createDataFrame([(9, 3, "Old", "active")], "id long, user_id int, shop_name string, status string")
    reqs = spark.createDataFrame([(3, "S1", T0, 1), (1, "S1", T0, 2), (2, "S1", T0, 3), (2, "S2", T0, 4),
                                  (1, "S3", T0, 5), (4, "S4", T0, 6)],
                                 "user_id int, shop_name string, change_ts timestamp, seq int")
    res = M.promote_sellers(users, sellers, reqs)
    new = sorted((r.user_id, r.shop_name) for r in res["sellers"].collect() if r.shop_name != "Old")
    assert new == [(1, "S1"), (2, "S2")]
    reasons = sorted((r.seq, r.reason) for r in res["rejected"].collect())
    assert reasons == [(1, "user is already a seller"), (3, "shop name is already taken"),
                       (5, "user is already a seller"), (6, "user not found")]


# ---------------------------------------------------------------- T1 / T5: moderation reverses counts
def test_comment_moved_off_approved_lowers_average(spark):
    comments = spark.createDataFrame([(1, "product", 7, 5, "approved"), (2, "product", 7, 1, "approved")],
                                     "id int, parent_type string, parent_id int, rating int, status string")
    before = A.ratings(comments).first().average_rating
    ch = spark.createDataFrame([(1, "rejected", T0, 1)], "comment_id int, status string, change_ts timestamp, seq int")
    res = M.moderate_comments(comments, ch)
    after = A.ratings(res["comments"]).first().average_rating
    assert before == Decimal("3.00") and after == Decimal("1.00")
    assert [tuple(r) for r in res["touched_parents"].collect()] == [("product", 7)]
