"""Properties: batch change application equals serial
application, chunked application equals one batch, cascade leaves no orphans,
nesting round-trips."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopframe.operators import audit as C
from shopframe.operators import changes as M

T0 = dt.datetime(2024, 1, 20)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

changes_st = st.lists(
    st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
              st.one_of(st.none(), st.sampled_from(["x", "y"]))),
    min_size=0, max_size=12)


def _serial(base, changes):
    state = {k: dict(v) for k, v in base.items()}
    for key, first, last in changes:
        if key not in state:
            continue  # an update of a missing row does nothing
        if first is not None:
            state[key]["first_name"] = first
        if last is not None:
            state[key]["last_name"] = last
    return state


BASE = {k: {"first_name": f"f{k}", "last_name": f"l{k}"} for k in range(3)}


def _frames(spark, changes):
    base = spark.createDataFrame([(k, v["first_name"], v["last_name"]) for k, v in BASE.items()],
                                 "id int, first_name string, last_name string")
    ch = spark.createDataFrame([(k, f, l, T0, i) for i, (k, f, l) in enumerate(changes)],
                               "id int, first_name string, last_name string, change_ts timestamp, seq int")
    return base, ch


@SETTINGS
@given(changes=changes_st)
def test_patch_batch_equals_serial(spark, changes):
    base, ch = _frames(spark, changes)
    got = {r.id: {"first_name": r.first_name, "last_name": r.last_name}
           for r in M.patch_coalesce(base, ch, "id", ["first_name", "last_name"]).collect()}
    assert got == _serial(BASE, changes)


@SETTINGS
@given(changes=changes_st, cut=st.integers(0, 12))
def test_chunked_apply_equals_one_batch(spark, changes, cut):
    base, ch = _frames(spark, changes)
    fields = ["first_name", "last_name"]
    once = M.patch_coalesce(base, ch, "id", fields)
    first = M.patch_coalesce(base, ch.where(ch.seq < cut), "id", fields)
    twice = M.patch_coalesce(first, ch.where(ch.seq >= cut), "id", fields)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(ch=st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.sampled_from(["A", "B", "C", "D", "E"]))),
                   max_size=7))
def test_renames_equal_serial_order(spark, ch):
    from test_edges import _serial_renames
    base = [(1, "A"), (2, "B"), (3, "C")]
    changes = [(k, n, i) for i, (k, n) in enumerate(ch)]
    b = spark.createDataFrame(base, "id int, shop_name string")
    c = spark.createDataFrame([(k, n, T0, s) for k, n, s in changes],
                              "id int, shop_name string, change_ts timestamp, seq int")
    res = M.rename_unique(b, c, "id", ["shop_name"])
    want, want_rej = _serial_renames(base, changes)
    assert {r.id: r.shop_name for r in res["base"].collect()} == want
    assert sorted((r.seq, r.reason) for r in res["rejected"].collect()) == want_rej


@SETTINGS
@given(roots=st.sets(st.integers(1, 4), max_size=4), sold=st.sets(st.integers(10, 17), max_size=8))
def test_cascade_leaves_no_orphans(spark, roots, sold):
    fks = [("products", "seller_id", "sellers", "cascade"), ("order_items", "product_id", "products", "restrict"),
           ("product_images", "product_id", "products", "cascade")]
    t = {"sellers": spark.createDataFrame([(i,) for i in range(1, 5)], "id int"),
         "products": spark.createDataFrame([(10 + i, 1 + i % 4) for i in range(8)], "id int, seller_id int"),
         "order_items": spark.createDataFrame([(100 + p, p) for p in sorted(sold)], "order_id int, product_id int"),
         "product_images": spark.createDataFrame([(200 + i, 10 + i) for i in range(8)], "id int, product_id int")}
    out = M.cascade_delete(t, "sellers", spark.createDataFrame([(r,) for r in sorted(roots)], "id int"), fks)
    assert C.orphans(out["products"], "products", "seller_id", out["sellers"]).count() == 0
    assert C.orphans(out["product_images"], "product_images", "product_id", out["products"]).count() == 0
    assert C.orphans(out["order_items"], "order_items", "product_id", out["products"], key="order_id").count() == 0
    blocked = {1 + (p - 10) % 4 for p in sold}
    kept = {r.id for r in out["sellers"].collect()}
    assert kept == ({1, 2, 3, 4} - set(roots)) | (set(roots) & blocked)
