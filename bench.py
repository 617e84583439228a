"""

Runs each query once to warm up, then three timed runs, each forcing full
evaluation with the ``noop`` sink (no collect to the driver), and prints
one JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}`` where
``value`` is the sum of per-query medians. Comparison forms (leaderboard
metric by metric, nest-first catalogue) are timed alongside but not summed.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shopframe.functions.ordering import order_spec  # noqa: E402
from shopframe.operators import nest as N  # noqa: E402
from shopframe.plans import reports as R  # noqa: E402
from shopframe.plans.registry import load_all, tables  # noqa: E402
from shopframe.session import get_session, scratch_path  # noqa: E402
from shopframe.sources.fixtures import land  # noqa: E402

# Headline queries (BASELINE "to be measured"): bench name -> registered query.
HEADLINE = {
    "q15_seller_leaderboard": "seller_leaderboard",
    "q15_seller_scorecard": "seller_scorecard",
    "q1_catalogue_page": "catalogue_page",
    "q1_catalogue_filtered": "catalogue_page_filtered",
    "q4_category_products": "category_products",
    "q10_seller_products": "seller_products",
    "q12_seller_orders": "seller_orders",
    "q12_seller_orders_raw": "seller_orders_raw",
    "q26_blog_listing": "blog_listing",
    "q28_moderation_list": "moderation_list",
    "a6_ratings": "ratings",
    "m4_cart_upsert": "cart_upsert",
    "m8_cascade_delete": "cascade_delete_cart_items",
    "w2_trailing_count": "trailing_attempts_hour",
}


def q15_metric_by_metric(spark, sf_dir):
    """Comparison: each metric of the leaderboard aggregated by itself for every seller, then the page."""
    t = tables(spark, sf_dir)
    owner = t["products"].select(F.col("id").alias("product_id"), F.col("seller_id").alias("owner"))
    sold = t["order_items"].join(t["shop_orders"].select(F.col("id").alias("order_id")), "order_id", "left_semi")

    def per_owner(rows, value):
        return rows.groupBy(F.col("owner").alias("id")).agg(value)

    amount = F.sum(F.col("quantity") * F.col("price_at_time"))
    parts = [per_owner(owner, F.count("*").alias("total_products")),
             per_owner(sold.join(owner, "product_id"), F.count("*").alias("total_orders")),
             per_owner(sold.join(owner, "product_id"), amount.alias("total_revenue"))]
    people = t["users"].select(F.col("id").alias("user_id"), "first_name", "last_name")
    board = t["sellers"].select("id", "shop_name", "status", "rating", "created_at", "user_id").join(people, "user_id")
    for part in parts:
        board = board.join(part, "id", "left")
    return board.na.fill(0).orderBy(*order_spec("created_at", "DESC")).limit(10)


def q1_nest_first(spark, sf_dir):
    """Comparison: nest children for every active product, then take the page."""
    t = tables(spark, sf_dir)
    spec = order_spec("created_at", "DESC")
    p = t["products"].where(F.col("status") == "active")
    p = R.with_seller(p, t["sellers"])
    p = N.nest_through(p, t["product_categories"], t["categories"], ("id", "product_id", "category_id", "id"),
                       [("id", "id"), "fa_name", "en_name"], "categories")
    p = N.nest(p, t["product_images"], ("id", "product_id"), ["id", "image_url", "is_main"], "images")
    p = N.nest(p, t["product_features"], ("id", "product_id"), ["name", "value"], "features")
    return p.orderBy(*spec).limit(10)


COMPARE = {"q15_metric_by_metric": q15_metric_by_metric, "q1_nest_first": q1_nest_first}


def run(df_fn, spark, sf_dir, runs):
    times = []
    for i in range(runs + 1):
        t0 = time.perf_counter()
        df_fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        if i > 0:  # first run is the warm-up
            times.append(dt)
    return statistics.median(times)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="shopframe-bench")
    qs = load_all()
    # Land the derived marketplace tables once as parquet (as production
    # lands its tables); reports then scan them. Landing is timed separately.
    t0 = time.perf_counter()
    # Order lines and orders are bucketed on the order id, so the order-existence
    # semi join of the seller reports is co-located (no exchange) at any scale.
    land(spark, sf_dir, scratch_path(spark, f"landed-{uuid.uuid4().hex[:12]}"),
         buckets={"order_items": ("order_id", cpus), "shop_orders": ("id", cpus)})
    landing = time.perf_counter() - t0
    results, compare = {}, {}
    for bname, qname in HEADLINE.items():
        results[bname] = round(run(qs[qname], spark, sf_dir, runs), 3)
    for bname, fn in COMPARE.items():
        compare[bname] = round(run(fn, spark, sf_dir, runs), 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "headline_total_median_sec",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "comparison": compare,
        "landing_sec": round(landing, 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "shuffle_partitions": cpus,
        "driver_memory": spark.conf.get("spark.driver.memory", "default"),
        "runs": runs,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
