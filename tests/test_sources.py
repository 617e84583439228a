"""Typed scans, versioned writes and checkpointed cascades."""

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopframe.operators import changes as M
from shopframe.session import scratch_path
from shopframe.sources.tables import append, load_table, read_version, write_version


def test_declared_schema_scan_with_integer_keys(spark):
    root = scratch_path(spark, f"test-s1-{uuid.uuid4().hex[:8]}")
    rows = [(1, 7, "Shop A", None, "active", dt.datetime(2024, 1, 1), None)]
    spark.createDataFrame(rows, "id bigint, user_id bigint, shop_name string, rating decimal(3,2), status string, "
                                "created_at timestamp, updated_at timestamp").write.parquet(f"{root}/sellers")
    df = load_table(spark, root, "sellers", declared=True, key_type=T.LongType())
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["user_id"] == "bigint"
    assert dict(df.dtypes)["rating"] == "decimal(3,2)"
    assert df.select("shop_name").first().shop_name == "Shop A"


def test_versions_are_written_side_by_side_and_retries_overwrite(spark):
    base = scratch_path(spark, f"test-s4-{uuid.uuid4().hex[:8]}")
    write_version(spark.range(3), base, 0)
    write_version(spark.range(5), base, 1)
    write_version(spark.range(5), base, 1)  # a retried batch rewrites only its own version
    assert read_version(spark, base, 0).count() == 3
    assert read_version(spark, base, 1).count() == 5
    path = f"{base}/appended"
    out = append(spark.range(2).withColumn("x", F.lit(1)), path, "a")
    append(spark.range(2).withColumn("x", F.lit(2)), path, "b")
    assert out.count() == 2 and spark.read.parquet(path).count() == 4


def test_checkpointed_cascade_gives_the_same_result(spark):
    fks = [("products", "seller_id", "sellers", "cascade"), ("order_items", "product_id", "products", "restrict"),
           ("product_images", "product_id", "products", "cascade"),
           ("product_features", "product_id", "products", "cascade")]
    t = {"sellers": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
         "products": spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id int, seller_id int"),
         "order_items": spark.createDataFrame([(100, 20)], "order_id int, product_id int"),
         "product_images": spark.createDataFrame([(5, 10), (6, 20), (7, 30)], "id int, product_id int"),
         "product_features": spark.createDataFrame([(10, "size", "1"), (30, "size", "2")],
                                                   "product_id int, name string, value string")}
    roots = spark.createDataFrame([(1,), (2,)], "id int")
    plain = M.cascade_delete(t, "sellers", roots, fks)
    ckpt = M.cascade_delete(t, "sellers", roots, fks)
    for name in ["sellers", "products", "product_images", "product_features", "__rejected"]:
        assert sorted(map(tuple, plain[name].collect())) == sorted(map(tuple, ckpt[name].collect())), name
    assert sorted(r.id for r in ckpt["sellers"].collect()) == [2, 3]
    assert [(r.product_id, r.value) for r in ckpt["product_features"].collect()] == [(30, "2")]
