"""Bounded tasks: the row counts of the joins decide the plan, and every plan gives the same rows."""

import pytest
from pyspark.sql import functions as F

from shopframe.operators import audit as C
from shopframe.operators import dealing as D


def _partitions(df, key):
    """The numbers of partitions that the plan's shuffles ask for by name."""
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}


def _orphan_rows(df):
    return sorted((r.key, r.value) for r in df.collect())


def test_orphans_deal_many_parents_by_rows(spark, monkeypatch):
    child = spark.range(400).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 300).alias("p"))
    parent = spark.range(250).unionByName(spark.range(5))
    want = _orphan_rows(C.orphans(child, "c", "p", parent))
    assert want == sorted((str(i), str(i % 300)) for i in range(400) if i % 10 and i % 300 >= 250)
    monkeypatch.setattr(D, "ROWS_A_TASK", 40)
    dealt = C.orphans(child, "c", "p", parent)
    assert _partitions(dealt, "p") == {10}  # 400 child rows, though both sides are small enough to be broadcast
    assert "BroadcastHashJoin" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert _orphan_rows(dealt) == want


def test_orphans_broadcast_few_parents(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_TASK", 100)
    child = spark.range(400).select("id", (F.col("id") % 60).alias("p"))
    few = C.orphans(child, "c", "p", spark.range(50))
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == sum(i % 60 >= 50 for i in range(400))


def test_scorecard_deals_lines_by_rows(spark, monkeypatch):
    from shopframe.operators import metrics as A
    users = spark.range(3).select("id", *[F.lit("x").alias(c) for c in ("first_name", "last_name", "email", "phone_number")])
    sellers = spark.range(3).selectExpr("id", "'s' AS shop_name", "'active' AS status", "1 AS rating",
                                        "DATE '2024-01-01' AS created_at", "id AS user_id")
    products = spark.range(60).select("id", F.when(F.col("id") > 0, F.col("id") % 3).alias("seller_id"))
    orders = spark.range(150).selectExpr("id", "'pending' AS status")
    lines = spark.range(400).selectExpr("id % 160 AS order_id", "id % 60 AS product_id", "2 AS quantity", "1.5BD AS price_at_time")
    board = lambda: sorted(A.seller_scorecard(sellers, users, products, lines, orders).collect())
    want = board()
    monkeypatch.setattr(D, "ROWS_A_TASK", 40)
    dealt = A.seller_scorecard(sellers, users, products, lines, orders)
    assert _partitions(dealt, "order_id") == {10}
    assert board() == want and sum(r.total_orders for r in want) == sum(i % 160 < 150 and i % 60 > 0 for i in range(400))


def test_lookup_deals_products_with_their_children(spark, monkeypatch):
    from shopframe.plans import reports as R
    t = {"products": spark.range(100).selectExpr("id", "'n' AS name", "id % 4 AS seller_id"),
         "sellers": spark.range(3).selectExpr("id", "'s' AS shop_name", "1 AS rating"),
         "categories": spark.range(2).selectExpr("id", "'f' AS fa_name", "'e' AS en_name"),
         "product_categories": spark.range(200).selectExpr("id % 100 AS product_id", "id % 3 AS category_id"),
         "product_images": spark.range(50).selectExpr("id", "id * 2 AS product_id", "'u' AS image_url", "true AS is_main"),
         "product_features": spark.range(30).selectExpr("id AS product_id", "'k' AS name", "'v' AS value")}
    keys = spark.range(0, 220, 2)
    want = sorted(map(str, R.product_details(t, keys).collect()))
    monkeypatch.setattr(R, "PARENTS_A_TASK", 10)
    dealt = R.product_details(t, keys)
    assert {n >= 10 for n in _partitions(dealt, "__fk")} == {True}
    assert sorted(map(str, dealt.collect())) == want and len(want) == 110


@pytest.mark.parametrize("rows, tasks", [(0, 0), (100, 0), (101, 2), (1000, 10)])
def test_tasks_grow_with_the_rows(rows, tasks):
    assert D.tasks_for(rows, 100) == tasks
