"""Forms for very deep pages, hot keys and repeated writes, against plain Python."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from shopframe.operators import audit as C
from shopframe.operators import changes as M
from shopframe.operators import paging as P
from shopframe.operators import windows as Wn
from shopframe.session import scratch_path
from shopframe.sources.tables import append

T0 = dt.datetime(2024, 1, 20)


# ---------------------------------------------------------------- L2
@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_deep_pages_equal_sorting(spark, direction):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 7, 7, 7, rng.randrange(50)]), f"n{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, price int, name string").repartition(5)
    down = direction == "DESC"
    want = sorted(rows, key=lambda r: ((r[1] is not None) if down else (r[1] is None),
                                       0 if r[1] is None else -r[1] if down else r[1], r[0]))
    for offset, limit in ((0, 10), (37, 25), (450, 200), (890, 50), (899, 1), (900, 5), (5000, 5)):
        got = P.deep_page(df, "price", direction, limit, offset, rows_per_range=60)
        assert [tuple(r) for r in got.collect()] == want[offset:offset + limit]
    assert P.deep_page(df.limit(0), "price", direction, 5, 0).collect() == []
    with pytest.raises(ValueError):
        P.deep_page(df, "price", direction, 0, 0)


# ---------------------------------------------------------------- W2
def _brute(rows, window):
    return {i: sum(1 for _, u2, t2 in rows if t is not None and u2 == u and t2 is not None and
                   t - window < t2 <= t) for i, u, t in rows}


@pytest.mark.parametrize("hot_rows", [0, 20, 10_000])
def test_trailing_counts_of_a_hot_key(spark, hot_rows):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), T0 + dt.timedelta(seconds=rng.randrange(4000))) for i in range(500)]
    rows += [(500 + i, 2, T0 + dt.timedelta(seconds=3600 * i)) for i in range(5)]
    rows += [(600 + i, 1, T0) for i in range(30)] + [(700, 4, None), (701, None, None)]
    df = spark.createDataFrame(rows, "id int, user_id int, at timestamp").repartition(6, "id")
    got = Wn.trailing_count(df, "user_id", "at", 3600, limit=3, hot_rows=hot_rows, rows_per_range=100)
    assert {r.id: r.n_in_window for r in got.collect()} == _brute(rows, dt.timedelta(hours=1))
    assert set(got.columns) == {"id", "user_id", "at", "n_in_window", "blocks_next"}


# ---------------------------------------------------------------- S4
def test_a_retried_append_adds_nothing(spark):
    path = scratch_path(spark, f"test-append-{uuid.uuid4().hex[:8]}")
    rows = spark.range(5).withColumn("token", F.expr("uuid()"))  # differs each time it is computed
    first = sorted(map(tuple, append(rows, path, "b1").collect()))
    again = sorted(map(tuple, append(rows, path, "b1").collect()))
    assert first == again and len(first) == 5
    append(rows, path, "b2")
    assert spark.read.parquet(path).count() == 10


def test_an_append_that_died_is_overwritten(spark):
    path = scratch_path(spark, f"test-append-{uuid.uuid4().hex[:8]}")
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=x")
    assert sorted(r.id for r in append(spark.range(3), path, "x").collect()) == [0, 1, 2]


# ---------------------------------------------------------------- C9 / C10
def test_uuids_of_order_documents_and_features_of_products(spark):
    good, bad = "0f8fad5b-d9cb-469f-a165-70867728950e", "17"
    docs = spark.createDataFrame([(1, good, "cash", [(good, 1, 5)]), (2, bad, "cash", [(good, 1, 5), (bad, 1, 5)])],
                                 "doc_id int, address_id string, payment_method string, "
                                 "items array<struct<product_id string, quantity int, price int>>")
    found = C.validate(docs, C.order_document_rules(uuid_keys=True), "doc_id")[1].where("rule like '%uuid'").collect()
    assert sorted((r.key, r.rule) for r in found) == [("2", "item_product_uuid"), ("2", "uuid")]
    assert C.validate(docs, C.order_document_rules(), "doc_id")[1].where("rule like '%uuid'").count() == 0
    texts = ['{"name":"a","price":5,"categories":["x"],"features":[{"name":"c","value":"d"}]}',
             '{"name":"a","price":5,"categories":["x"],"features":[{"name":"c","value":"d"},{"name":"c"}]}',
             '{"name":"a","price":5,"categories":["x"]}']
    frame = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, seller_id int, document string")
    res = M.create_products(frame)
    assert [(r.key, r.rule) for r in res["violations"].collect()] == [("1", "feature")]
    assert res["products"].count() == 2
