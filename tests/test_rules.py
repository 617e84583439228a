"""Null keys, repeated paths, refusals and orders: cases in which rows were lost or the outcome depended on sizes."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopframe.operators import changes as M
from shopframe.operators import windows as Wn
from shopframe.operators.paging import keyset_page
from shopframe.session import scratch_path
from shopframe.streaming import jobs as S

T0 = dt.datetime(2024, 1, 20, 10, 0, 0)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def fresh(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex[:8]}")


def test_rate_limit_does_not_depend_on_arrow_batches(spark):
    rows = [("u", minutes(m)) for m in (40, 0, 50, 10, 30, 20)] + [("v", None)]
    df = spark.createDataFrame(rows, "who string, ts timestamp")
    df = df.unionByName(S.close_feed(df, "ts", "1 DAY")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        feed = S.Feed(df, "ts", fresh(spark, "rl"), parts=1)
        with S.keyed_state(spark):
            feed.run(S.rate_limited(feed.stream, key="who", limit=2), S.batch_writer(f"{feed.root}/out"), "append")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    out = {(r.who, r.ts): r.accepted for r in spark.read.parquet(f"{feed.root}/out").collect()}
    assert out == {("u", minutes(m)): m in (0, 10) for m in (0, 10, 20, 30, 40, 50)} | {("v", None): False}


def test_feed_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame([(1, T0), (2, None), (3, minutes(9))], "id int, ts timestamp")
    feed = S.Feed(df, "ts", fresh(spark, "feed"))
    feed.run(feed.stream, S.batch_writer(f"{feed.root}/out"), "append")
    assert sorted(r.id for r in spark.read.parquet(f"{feed.root}/out").collect()) == [1, 2, 3]


def test_tokens_without_a_creation_time_are_kept(spark):
    schema = "id long, user_id long, token string, expires_at timestamp, is_revoked boolean, created_at timestamp"
    new = spark.createDataFrame([(1, 1, "a", minutes(60), False, None)], schema)
    assert S.expire_tokens_batch(new.limit(0), new, 0).count() == 1


def test_state_with_a_null_key(spark):
    root = fresh(spark, "state")
    handle = S.batch_writer(root)
    handle(spark.createDataFrame([(None, 1), (5, 1)], "k int, n int"), 0)
    handle(spark.createDataFrame([(None, 2)], "k int, n int"), 1)
    assert sorted(map(tuple, S.current_state(spark, root, ["k"]).collect()), key=str) == [(5, 1), (None, 2)]


def test_requests_with_null_parts_are_refused_not_lost(spark):
    base = spark.createDataFrame([(1, "a", "A")], "id long, fa_name string, en_name string")
    new = spark.createDataFrame([("b", None, T0, 1), ("c", "C", T0, 2)],
                                "fa_name string, en_name string, change_ts timestamp, seq long")
    res = M.create_unique(base, new, "categories", ["fa_name", "en_name"], "category")
    assert res["inserted"].count() == 1
    assert [(r.fa_name, r.reason) for r in res["rejected"].collect()] == [("b", "name is missing")]

    rows = spark.createDataFrame([(1,), (2,)], "id int")
    owners = spark.createDataFrame([(1, 7), (2, 8)], "id int, owner_id int")
    res = M.owned_delete(rows, spark.createDataFrame([(1, None), (2, 8)], "id int, requester_id int"), owners)
    assert [r.id for r in res["deleted"].collect()] == [2]
    assert [r.id for r in res["rejected"].collect()] == [1]

    comments = spark.createDataFrame([(1, "pending", "product", 5)],
                                     "id int, status string, parent_type string, parent_id int")
    wanted = spark.createDataFrame([(1, "approved", T0, 1), (1, "odd", T0, 2), (9, "approved", T0, 3), (1, None, T0, 4)],
                                   "comment_id int, status string, change_ts timestamp, seq long")
    res = M.moderate_comments(comments, wanted)
    assert [r.status for r in res["comments"].collect()] == ["approved"]
    assert sorted((r.seq, r.reason) for r in res["rejected"].collect()) == [
        (2, "invalid status"), (3, "comment not found"), (4, "invalid status")]


def test_promotion_ends_with_a_null_name(spark):
    users = spark.createDataFrame([(1, "customer"), (2, "customer")], "id long, role string")
    sellers = spark.createDataFrame([], "id long, user_id long, shop_name string, status string")
    asked = spark.createDataFrame([(1, None, T0, 1), (2, "S", T0, 2), (None, "T", T0, 3)],
                                  "user_id long, shop_name string, change_ts timestamp, seq long")
    res = M.promote_sellers(users, sellers, asked)
    assert [r.shop_name for r in res["sellers"].collect()] == ["S"]
    assert sorted(r.reason for r in res["rejected"].collect()) == ["shop name is missing", "user not found"]


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_keyset_walk_reaches_null_sort_values(spark, direction):
    data = [(1, None), (2, 5), (3, None), (4, 5), (5, 1), (6, 9), (7, None)]
    df = spark.createDataFrame(data, "id int, v int")
    seen, value, last = [], None, None
    while True:
        rows = keyset_page(df, "v", direction, value, last, limit=2).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        value, last = rows[-1].v, rows[-1].id
    want = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0])) if direction == "ASC" else sorted(
        data, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert seen == [r[0] for r in want]


def test_rows_without_a_time_are_in_no_trailing_window(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, T0)], "id int, user_id int, created_at timestamp")
    out = {r.id: (r.n_in_window, r.blocks_next)
           for r in Wn.trailing_count(df, "user_id", "created_at", 3600, limit=1).collect()}
    assert out == {1: (0, False), 2: (0, False), 3: (1, True)}


def plain_cascade(tables, fks, table, keys):
    gone = {t: set() for t in tables}
    todo = [(table, k) for k in keys]
    while todo:
        t, k = todo.pop()
        if k in gone[t]:
            continue
        gone[t].add(k)
        for child, col, parent, _ in fks:
            if parent == t:
                todo += [(child, r["id"]) for r in tables[child] if r[col] == k]
    return {t: sorted(r["id"] for r in rows if r["id"] not in gone[t]) for t, rows in tables.items()}


def test_cascade_over_a_diamond_and_a_cycle(spark):
    """Random tables a -> b, a -> c, c -> b, b -> d and b -> b, the edges listed in any order."""
    rng = random.Random(5)
    fks = [("b", "a_id", "a", "cascade"), ("c", "a_id", "a", "cascade"), ("b", "c_id", "c", "cascade"),
           ("d", "b_id", "b", "cascade"), ("b", "b_id", "b", "cascade")]
    for _ in range(3):
        def some(n, *cols):
            return [{"id": i} | {c: rng.choice([None, *range(8)]) for c in cols} for i in range(n)]
        rows = {"a": some(8), "b": some(14, "a_id", "c_id", "b_id"), "c": some(8, "a_id"), "d": some(14, "b_id")}
        frames = {t: spark.createDataFrame([tuple(r.values()) for r in v], ", ".join(f"{c} int" for c in v[0]))
                  for t, v in rows.items()}
        rng.shuffle(fks)
        roots = rng.sample(range(8), 2)
        out = M.cascade_delete(frames, "a", spark.createDataFrame([(k,) for k in roots], "id int"), fks)
        assert {t: sorted(r.id for r in out[t].collect()) for t in rows} == plain_cascade(rows, fks, "a", roots)


def test_derived_keys(spark):
    df = spark.createDataFrame([(None, 5, T0), (5, None, T0), (5, 1, T0), (5, 1, minutes(1))],
                               "user_id long, seq long, change_ts timestamp")
    keys = df.select(M.new_key(T.LongType(), "x", "user_id", *M.request_key()).alias("id"))
    assert keys.distinct().count() == 4
    with pytest.raises(ValueError):
        M.new_key(T.IntegerType(), "x", "user_id")
    base = spark.createDataFrame([(1,), (2,)], "id long")
    new = spark.createDataFrame([(2,), (3,), (3,), (4,)], "id long")
    assert sorted(map(tuple, M.key_clashes(base, new).collect())) == [(2, 2), (3, 2)]


def test_admin_comments_start_approved(spark):
    comments = spark.createDataFrame([], "id long, user_id long, parent_type string, parent_id long, content string, "
                                         "rating int, status string, created_at timestamp")
    new = spark.createDataFrame([(1, "product", 1, "fine", 5, T0, 1), (2, "product", 1, "fine", 5, T0, 1)],
                                "user_id long, parent_type string, parent_id long, content string, rating int, "
                                "change_ts timestamp, seq long")
    users = spark.createDataFrame([(1, "admin"), (2, "customer")], "id long, role string")
    parents = {"product": spark.createDataFrame([(1,)], "id long")}
    got = {r.user_id: r.status for r in M.create_comments(comments, new, parents, users)["inserted"].collect()}
    assert got == {1: "approved", 2: "pending"}


def test_quantity_change_touches_its_cart(spark):
    carts = spark.createDataFrame([(1, 1, T0), (2, 2, T0)], "id int, user_id int, updated_at timestamp")
    items = spark.createDataFrame([(1, 5, 1, 10)], "cart_id int, product_id int, quantity int, price int")
    products = spark.createDataFrame([(5, 12, 9)], "id int, price int, stock int")
    change = spark.createDataFrame([(1, 1, 5, 3, T0, 1)],
                                   "user_id int, cart_id int, product_id int, quantity int, change_ts timestamp, seq long")
    res = M.update_cart_quantity(carts, items, products, change, as_of=minutes(5))
    assert {r.id: r.updated_at for r in res["carts"].collect()} == {1: minutes(5), 2: T0}
    assert [(r.quantity, r.price) for r in res["cart_items"].collect()] == [(3, 12)]


def test_first_of_batch_equals_one_by_one(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, *"abcdef"]), rng.choice([None, *"123456"])) for i in range(30)]
    got = {r.i for r in M.first_of_batch(spark.createDataFrame(rows, "i int, e string, p string"), ["e", "p"], "i")
           ["accepted"].collect()}
    mails, phones, want = set(), set(), set()
    for i, e, p in rows:
        if (e is None or e not in mails) and (p is None or p not in phones):
            want.add(i)
            mails.add(e)
            phones.add(p)
            mails.discard(None)
            phones.discard(None)
    assert got == want


def test_order_totals_need_no_line_join(spark):
    doc = '{"address_id":"1","payment_method":"cash","items":[{"product_id":"1","quantity":2,"price":1.50},{"quantity":null}]}'
    df = spark.createDataFrame([(1, 7, doc), (2, 8, '{"items":[]}'), (3, 9, None)], "doc_id long, user_id long, document string")
    got = {r.doc_id: (r.user_id, str(r.total_amount)) for r in M.place_orders(df)["orders"].collect()}
    assert got == {1: (7, "3.00"), 2: (8, "0.00"), 3: (9, "0.00")}


def test_payload_rules(spark):
    from shopframe.operators import audit as C
    uuid_ = "123e4567-e89b-12d3-a456-426614174000"
    line = "id int, product_id string, quantity int"
    rows = spark.createDataFrame([(1, uuid_, 2), (2, "5", 1), (3, None, 0)], line)
    found = {(r.key, r.rule, r.column) for r in C.validate(rows, C.payload_rules("cart_create", True), "id")[1].collect()}
    assert found == {("2", "uuid", "product_id"), ("3", "required", "product_id"), ("3", "range", "quantity")}
    schema = ("id int, name string, price int, categories array<string>, stock int, status string, "
              "features array<struct<name string, value string>>")
    rows = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "", 0, [], -1, "odd", [("a", None)]),
                                  (3, "n", 1, [uuid_], 0, "active", [("a", "b")]), (4, "n", 1, ["x"], 0, "active", [])], schema)
    found = {(r.key, r.rule) for r in C.validate(rows, C.payload_rules("product_update", True), "id")[1].collect()}
    assert found == {("2", "length"), ("2", "range"), ("2", "array_size"), ("2", "allowed"), ("2", "feature"), ("4", "uuid")}
    rows = spark.createDataFrame([(1, "ab"), (2, "x" * 51), (3, "fine")], "user_id int, shop_name string")
    assert {r.key for r in C.validate(rows, C.payload_rules("seller_create"), "user_id")[1].collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        C.payload_rules("invoice_create")
