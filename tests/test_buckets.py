"""Bucketed tables: only touched buckets are written, commits are atomic, batches apply once, old folders go."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from shopframe.operators import changes as M
from shopframe.session import scratch_path
from shopframe.sources.buckets import BucketedTable


@pytest.fixture
def table(spark):
    rows = spark.range(400).select("id", F.concat(F.lit("n"), "id").alias("name"))
    root = scratch_path(spark, f"test-buckets-{uuid.uuid4().hex[:10]}").removeprefix("file:")
    return BucketedTable.create(rows, root, "id", buckets=20)


def patch(rows, batch):
    return M.patch_coalesce(rows, batch, "id", ["name"])


def changes(spark, pairs):
    return spark.createDataFrame([(i, n, 0, k) for k, (i, n) in enumerate(pairs)], "id long, name string, change_ts int, seq int")


def folders(table, version):
    return sorted(b for b in os.listdir(f"{table.root}/rows") if os.path.isdir(f"{table.root}/rows/{b}/v={version}"))


def test_a_batch_writes_its_buckets_only(spark, table):
    before = {r.id: r.name for r in table.read().collect()}
    assert len(before) == 400 and len(folders(table, 0)) == 20
    batch = changes(spark, [(7, "x"), (8, "y"), (7, "z")])
    assert table.apply(batch, 0, patch)
    assert {r.id: r.name for r in table.read().collect()} == {**before, 7: "z", 8: "y"}
    touched = table.touched(batch)
    assert folders(table, 1) == sorted(f"b={b}" for b in touched) and len(touched) <= 2
    assert table.read(touched).count() < 80


def test_restart_and_repeated_batches(spark, table):
    table.apply(changes(spark, [(1, "a")]), 0, patch)
    again = BucketedTable.open(spark, table.root)  # a new driver knows only the folder
    assert (again.version(), again.last_batch(), again.key, again.buckets) == (1, 0, ["id"], 20)
    assert not again.apply(changes(spark, [(1, "b")]), 0, patch)
    assert again.apply(changes(spark, [(1, "c")]), 1, patch) and again.version() == 2
    assert again.read().where("id = 1").first().name == "c" and again.read().count() == 400


def test_a_batch_that_dies_before_its_commit(spark, table, monkeypatch):
    batch = changes(spark, [(i, "new") for i in range(50)])
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            table.apply(batch, 0, patch)
    assert folders(table, 1) and table.version() == 0 and table.read().where("name = 'new'").count() == 0
    more = changes(spark, [(i, "new") for i in range(40)])  # the repeated batch may be cut otherwise
    assert table.apply(more, 0, patch)
    assert table.read().where("name = 'new'").count() == 40 and table.read().count() == 400


def test_inserts_deletes_and_empty_buckets(spark, table):
    def change(rows, batch):
        gone = batch.where("name is null").select("id")
        return rows.join(gone, "id", "left_anti").unionByName(batch.where("name is not null").select("id", "name"))
    table.apply(changes(spark, [(i, None) for i in range(400)]), 0, change)
    assert table.read().count() == 0
    table.apply(changes(spark, [(1000, "p"), (1001, "q")]), 1, change)
    table.apply(changes(spark, []), 2, change)
    assert sorted(r.name for r in table.read().collect()) == ["p", "q"] and table.last_batch() == 2


def test_rows_must_stay_in_their_bucket(spark, table):
    with pytest.raises(Exception, match="left its bucket"):
        table.apply(changes(spark, [(1, "a")]), 0, lambda rows, batch: rows.withColumn("id", F.col("id") + 1))
    assert table.version() == 0 and table.read().count() == 400


def test_clean_up_keeps_the_last_versions(spark, table):
    for n in range(5):
        table.apply(changes(spark, [(3, f"v{n}")]), n, patch, keep=2)
    assert sorted(os.listdir(f"{table.root}/versions")) == ["v=4", "v=5"]
    bucket = f"{table.root}/rows/b={table.touched(changes(spark, [(3, '')]))[0]}"
    assert sorted(os.listdir(bucket)) == ["v=4", "v=5"] and table.read().where("id = 3").first().name == "v4"
    assert table.read().count() == 400


def test_null_and_compound_keys(spark):
    rows = spark.createDataFrame([(None, 1, "a"), ("p", None, "b"), ("p", 2, "c")], "kind string, id long, name string")
    root = scratch_path(spark, f"test-buckets-{uuid.uuid4().hex[:10]}")
    table = BucketedTable.create(rows, root, ["kind", "id"], buckets=4)
    assert sorted(r.name for r in table.read().collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        BucketedTable.create(rows.withColumnRenamed("name", "v"), root + "x", "id")
