"""Physical-plan properties the design relies on at scale (checked with
explain output, not timings)."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from shopframe.functions.ordering import order_spec
from shopframe.operators import metrics as A
from shopframe.operators import windows as Wn
from shopframe.operators.paging import of_page, page_per_key, page_rows
from shopframe.plans import reports as R
from shopframe.sources.fixtures import marketplace
from shopframe.session import scratch_path
from shopframe.sources.tables import save_bucketed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_order_tables_join_without_exchange(spark, no_broadcast):
    root = scratch_path(spark, f"test-bucket-{uuid.uuid4().hex[:8]}")
    tag = uuid.uuid4().hex[:8]
    lines = spark.range(2000).select((F.col("id") % 300).alias("order_id"), (F.col("id") % 50).alias("product_id"),
                                     F.lit(1).alias("quantity"), F.lit(2).cast("decimal(12,2)").alias("price_at_time"))
    orders = spark.range(300).select(F.col("id"), F.lit("pending").alias("status"))
    li = save_bucketed(lines, f"t_lines_{tag}", f"{root}/lines", "order_id", 4)
    od = save_bucketed(orders.withColumnRenamed("id", "id"), f"t_orders_{tag}", f"{root}/orders", "id", 4)
    semi = A.items_in_orders(li, od)
    p = plan(semi)
    assert "SortMergeJoin" in p and "Exchange" not in p, p
    assert semi.count() == 2000


def test_page_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id"))
    p = plan(page_per_key(df, "k", [F.col("id").desc()], limit=3))
    limit_at = p.find("WindowGroupLimit")
    exchange_at = p.find("Exchange")
    assert limit_at != -1 and exchange_at != -1
    # explain prints parents first: the partial limit appears twice, the last one below the exchange
    assert p.rfind("WindowGroupLimit") > exchange_at


def test_children_of_a_page_are_read_in_parallel(spark):
    """The child table of several files is filtered by the page in its own tasks: no shuffle, no single task."""
    path = scratch_path(spark, f"test-in-{uuid.uuid4().hex[:8]}")
    spark.range(8000).select(F.col("id").alias("product_id"), F.col("id").alias("x")).repartition(8).write.parquet(path)
    child = spark.read.parquet(path)
    rows = page_rows(spark.range(100), [F.col("id").desc()], limit=10)
    out = of_page(child, "product_id", rows, 10)
    p = plan(out)
    assert "BroadcastHashJoin" in p and "Coalesce" not in p and "hashpartitioning(product_id" not in p, p
    assert sorted(r.product_id for r in out.collect()) == list(range(90, 100))
    assert "BroadcastHashJoin" not in plan(of_page(child.hint("merge"), "product_id", rows, 1_000_000))


def test_pages_scan_their_table_once_and_end_in_a_top_k(spark, sf_dir):
    """Landed tables of eight files: the page's own scan is the checkpoint's, so the rest reads other tables only, and
    no single task stands over a scan."""
    t = {}
    source = marketplace(spark, sf_dir)
    for name in ("products", "sellers", "users", "categories", "product_categories", "product_images",
                 "product_features", "comments", "blogs", "blog_tags", "order_items", "shop_orders"):
        df = source[name]
        path = scratch_path(spark, f"test-page-{uuid.uuid4().hex[:8]}/{name}")
        df.repartition(8).write.parquet(path)
        t[name] = spark.read.parquet(path)
    for rows, table in ((R.moderation_list(t), "comments"), (R.catalogue_page(t), "products"),
                        (R.user_listing(t), "users"), (R.blog_listing(t), "blogs"), (R.seller_leaderboard(t), "sellers")):
        p = plan(rows)
        assert "TakeOrderedAndProject" in p and "Coalesce 1" not in p, p
        assert sum(f"/{table}]" in line for line in p.splitlines() if "FileScan" in line) == 0, (table, p)


def test_scorecard_aggregates_lines_per_product_before_the_product_join(spark, no_broadcast):
    items = spark.range(1000).select((F.col("id") % 100).alias("order_id"), (F.col("id") % 40).alias("product_id"),
                                     F.lit(1).alias("quantity"), F.lit(3).cast("decimal(12,2)").alias("price_at_time"))
    orders = spark.range(100).select("id")
    products = spark.range(40).select("id", (F.col("id") % 4).alias("seller_id"))
    sellers = spark.range(4).select("id", F.col("id").alias("user_id"), F.lit("s").alias("shop_name"),
                                    F.lit(None).cast("decimal(3,2)").alias("rating"), F.lit("active").alias("status"),
                                    F.lit(None).cast("date").alias("created_at"))
    users = spark.range(4).select("id", F.lit("a").alias("first_name"), F.lit("b").alias("last_name"),
                                  F.lit("e").alias("email"), F.lit("p").alias("phone_number"))
    df = A.seller_scorecard(sellers, users, products, items, orders, with_distinct_orders=False)
    p = plan(df)
    assert "partial_sum" in p and "keys=[product_id" in p, p
    rows = {r.id: (r.total_products, r.total_orders, str(r.total_revenue)) for r in df.collect()}
    assert rows[0] == (10, 250, "750.00")


def test_scorecard_with_a_hot_seller_matches_brute_force(spark, no_broadcast):
    """One seller owns a third of all order lines; shuffle paths (no broadcast)
    must still give exact totals."""
    from decimal import Decimal
    n = 3000
    lines = [(i % 400, (0 if i % 3 == 0 else 1 + i % 39), 1 + i % 4, Decimal(f"{1 + i % 7}.25")) for i in range(n)]
    items = spark.createDataFrame(lines, "order_id long, product_id long, quantity int, price_at_time decimal(12,2)")
    orders = spark.range(400).select("id")
    products = spark.range(40).select("id", F.when(F.col("id") == 0, 0).otherwise(F.col("id") % 5).alias("seller_id"))
    sellers = spark.range(5).select("id", F.col("id").alias("user_id"), F.lit("s").alias("shop_name"),
                                    F.lit(None).cast("decimal(3,2)").alias("rating"), F.lit("active").alias("status"),
                                    F.lit(None).cast("date").alias("created_at"))
    users = spark.range(5).select("id", F.lit("a").alias("first_name"), F.lit("b").alias("last_name"),
                                  F.lit("e").alias("email"), F.lit("p").alias("phone_number"))
    got = {r.id: (r.total_products, r.total_orders, r.total_revenue, r.distinct_orders)
           for r in A.seller_scorecard(sellers, users, products, items, orders).collect()}
    seller_of = {p: (0 if p == 0 else p % 5) for p in range(40)}
    want = {}
    for s in range(5):
        mine = [ln for ln in lines if seller_of[ln[1]] == s]
        want[s] = (sum(1 for p in range(40) if seller_of[p] == s), len(mine),
                   sum((q * pr for _, _, q, pr in mine), Decimal("0.00")), len({o for o, _, _, _ in mine}))
    assert got == want
    assert got[0][1] >= n // 3


def test_trailing_count_partitions_by_key_and_time_bucket(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, 1, t0 + dt.timedelta(minutes=7 * i)) for i in range(50)],
                               "id int, user_id int, created_at timestamp")
    p = plan(Wn.trailing_count(df, "user_id", "created_at", 3600))
    assert "Exchange hashpartitioning(user_id" in p and "__b" in p.split("Exchange hashpartitioning(user_id")[1][:80]


def test_listing_page_order_needs_no_range_sort(spark):
    from shopframe.operators.paging import in_page_order
    df = spark.range(100).select("id")
    p = plan(in_page_order(df, order_spec("id", "DESC", tie_break="id"), 10))
    assert "rangepartitioning" not in p


def test_order_documents_are_parsed_once_to_be_checked(spark, sf_dir):
    import __spark_entry__ as E
    for name in ("place_orders", "place_orders_items", "validate_payloads"):
        plan = E.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        # once for the rules, once for the orders that pass them
        assert 1 <= plan.count("from_json(") <= 2, (name, plan.count("from_json("))


def test_parsing_once_keeps_every_row(spark):
    from shopframe.operators import changes as M
    docs = spark.createDataFrame([(1, '{"name": "a", "stock": 2}'), (2, "no json"), (3, None), (3, "{}")], "id int, d string")
    rows = M.parse_once(docs, "d", M.PRODUCT_DOC_SCHEMA, "p").where("p.stock = 2 or p.name is null").collect()
    assert sorted((r.id, r.p and r.p.stock) for r in rows) == sorted(
        (r.id, r.p and r.p.stock) for r in docs.withColumn("p", F.from_json("d", M.PRODUCT_DOC_SCHEMA)).collect())
