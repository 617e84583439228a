"""Streaming behaviour that the batch twins cannot show: state across
micro-batches, late rows behind the watermark (T7), idempotent batch output."""

import datetime as dt
import random
import time
import uuid

from pyspark.sql import functions as F

from shopframe.operators import changes as M
from shopframe.operators import metrics as A
from shopframe.session import scratch_path
from shopframe.sources.buckets import BucketedTable
from shopframe.streaming import jobs as S

T0 = dt.datetime(2024, 1, 20, 10, 0, 0)


def _write_in_order(spark, path, batches, schema):
    for rows in batches:  # one file per batch, oldest modification time first
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def test_watermark_advances_and_window_state_spans_batches(spark):
    root = scratch_path(spark, f"test-wm-{uuid.uuid4().hex[:8]}")
    schema = "user_id int, ts timestamp"
    _write_in_order(spark, f"{root}/feed", [
        [(1, T0), (1, T0 + dt.timedelta(hours=2))],                   # watermark -> T0 + 1h
        [(1, T0 + dt.timedelta(minutes=75)), (1, T0 + dt.timedelta(hours=2, minutes=5))],  # on time
    ], schema)
    stream = S.read_changes(spark, f"{root}/feed", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    q = S.run_batches(S.request_counts(stream, watermark="1 hour"), S.batch_writer(f"{root}/out"), f"{root}/ckpt")
    marks = [p["eventTime"].get("watermark") for p in q.recentProgress if p["numInputRows"]]
    assert marks[-1].startswith("2024-01-20T11:00:00")
    state = S.current_state(spark, f"{root}/out", ["user_id", "window_start"])
    got = sorted((r.window_start, r.n) for r in state.collect())
    assert got == [(T0, 1), (T0 + dt.timedelta(minutes=75), 1), (T0 + dt.timedelta(hours=2), 2)]


def test_running_ratings_across_batches(spark):
    root = scratch_path(spark, f"test-rt-{uuid.uuid4().hex[:8]}")
    schema = "parent_type string, parent_id int, rating int, status string, created_at timestamp"
    _write_in_order(spark, f"{root}/feed", [
        [("product", 1, 5, "approved", T0), ("product", 1, 2, "pending", T0)],
        [("product", 1, 4, "approved", T0), ("blog", 2, 3, "approved", T0)],
    ], schema)
    stream = S.read_changes(spark, f"{root}/feed", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    S.run_batches(S.rating_sums_stream(stream), S.batch_writer(f"{root}/out"), f"{root}/ckpt")
    out = {(r.parent_type, r.parent_id): (r.n_ratings, str(r.average_rating))
           for r in S.ratings_from_state(S.current_state(spark, f"{root}/out", ["parent_type", "parent_id"])).collect()}
    assert out == {("product", 1): (2, "4.50"), ("blog", 2): (1, "3.00")}
    # two micro-batches were written, each under its own batch id
    assert spark.read.parquet(f"{root}/out").select("batch_id").distinct().count() == 2


def _serial_rate_limit(rows, limit, window):
    out, accepted = {}, {}
    for user, ts in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        kept = [t for t in accepted.get(user, []) if t > ts - window]
        ok = len(kept) < limit
        out[(user, ts)] = (ok, len(kept))
        accepted[user] = kept + ([ts] if ok else [])
    return out


def test_rate_limit_matches_serial_brute_force(spark, sf_dir):
    import __spark_entry__ as E
    got = {(r.user_id, r.ts): (r.accepted, r.recent)
           for r in E.queries()["stream_rate_limited_codes"](spark, sf_dir).collect()}
    from shopframe.plans.registry import tables
    rows = [(r.user_id, r.created_at) for r in tables(spark, sf_dir)["email_verifications"].collect()]
    assert got == _serial_rate_limit(rows, 5, dt.timedelta(days=1))


def _stream(spark, batches, schema, job, handler, output="append", before=lambda i: None):
    """Run ``job`` over one file a micro-batch with a checkpoint that is reopened for each of them."""
    root = scratch_path(spark, f"test-st-{uuid.uuid4().hex[:8]}")
    kind = spark.createDataFrame([], schema).schema
    spark.createDataFrame([], kind).coalesce(1).write.parquet(f"{root}/feed")
    stream = S.read_changes(spark, f"{root}/feed", kind)
    with S.keyed_state(spark):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{root}/feed")
            S.run_batches(job(stream), handler(root), f"{root}/ckpt", output_mode=output)
            before(i)
    return root


def _minutes(user, *minutes):
    return [(user, T0 + dt.timedelta(minutes=m)) for m in minutes]


def test_rate_limit_in_any_order_within_the_delay(spark):
    rng = random.Random(4)
    rows = [(u, T0 + dt.timedelta(seconds=rng.randrange(6 * 3600))) for u in range(6) for _ in range(60)]
    rows += _minutes(90, 0, 0, 0, 0, 0, 0, 59, 60) + _minutes(91, 10)
    rows = list(dict.fromkeys(rows))
    # up to 50 minutes late, dealt to six micro-batches; then a row that lets the watermark pass all of them
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))
    cut = len(order) // 6 + 1
    batches = [order[i:i + cut] for i in range(0, len(order), cut)]
    batches[-1] = batches[-1] + [(None, max(t for _, t in rows) + dt.timedelta(hours=2)), (5, None)]
    root = _stream(spark, batches, "user_id long, ts timestamp", lambda s: S.rate_limited(s, watermark="1 hour"),
                   lambda r: S.batch_writer(f"{r}/out"))
    got = spark.read.parquet(f"{root}/out").collect()
    assert len(got) == len(rows) + 1
    assert [(r.user_id, r.accepted) for r in got if r.ts is None] == [(5, False)]
    assert {(r.user_id, r.ts): (r.accepted, r.recent) for r in got if r.ts} == _serial_rate_limit(
        rows, 5, dt.timedelta(hours=1))


def test_rate_limit_counts_equal_times_and_carries_state(spark):
    batches = [_minutes(1, 0, 5, 10, 15, 20, 20, 20), _minutes(1, 30, 61, 70, 200) + _minutes(2, 31),
               _minutes(None, 600)]
    root = _stream(spark, batches, "user_id long, ts timestamp", S.rate_limited, lambda r: S.batch_writer(f"{r}/out"))
    got = sorted((r.user_id, r.ts, not r.accepted) for r in spark.read.parquet(f"{root}/out").collect())
    assert [(u, int((t - T0).total_seconds() / 60), no) for u, t, no in got] == [
        (1, 0, False), (1, 5, False), (1, 10, False), (1, 15, False), (1, 20, False), (1, 20, True), (1, 20, True),
        (1, 30, True), (1, 61, False), (1, 70, False), (1, 200, False), (2, 31, False)]


COMMENT = "id long, parent_type string, parent_id long, rating int, status string, deleted boolean, change_ts timestamp, seq int"


def test_ratings_take_back_what_a_comment_gave(spark):
    rng = random.Random(6)
    known = [(i, "product", i % 3, 1 + i % 5, ["approved", "pending"][i % 2]) for i in range(12)]
    images, seen = {r[0]: r[1:] for r in known}, []

    def write(n):
        i = rng.randrange(16)
        new = i >= 12 and i not in images
        return (i, "product" if new or rng.random() < 0.2 else None, rng.randrange(3) if new or rng.random() < 0.2 else None,
                rng.randrange(1, 6) if new or rng.random() < 0.3 else None,
                rng.choice(["approved", "approved", "rejected", None]) if not new else "approved",
                rng.random() < 0.1, T0 + dt.timedelta(minutes=n // 4), n)
    batches = []
    for b in range(3):
        batch = []
        for n in range(b * 40, b * 40 + 14):
            w = write(n)
            batch.append(w)
            if w[5]:
                images[w[0]] = (None, None, None, "deleted")
            else:
                old = images.get(w[0], (None,) * 4)
                images[w[0]] = tuple(o if v is None else v for v, o in zip(w[1:5], old))
        rng.shuffle(batch)
        batches.append(batch)
        sums = {}
        for kind, parent, rating, status in images.values():
            if status == "approved" and rating is not None:
                total, count = sums.get((kind, parent), (0, 0))
                sums[(kind, parent)] = (total + rating, count + 1)
        seen.append(sums)
    base = spark.createDataFrame(known, "id long, parent_type string, parent_id long, rating int, status string")
    tables = {}

    def handler(root):
        if root not in tables:
            tables[root] = BucketedTable.create(A.approved_rating_sums(base), f"{root}/sums", ["parent_type", "parent_id"], 4)
        table = BucketedTable.open(spark, f"{root}/sums")
        return S.landed_batches(S.bucketed_apply(table, S.add_rating_deltas), f"{root}/deltas")

    def compare(i):
        table = BucketedTable.open(spark, f"{next(iter(tables))}/sums")
        got = {(r.parent_type, r.parent_id): (r.rating_sum, r.rating_count) for r in table.read().collect()}
        assert got == seen[i], i
    _stream(spark, batches, COMMENT, lambda s: S.rating_deltas(s, base), handler, before=compare)


def _state_rows(spark, root, stream, handler):
    """Rows of keyed state after a run, whatever the number of keys in it."""
    with S.keyed_state(spark):
        q = S.run_batches(stream, handler, f"{root}/ckpt", output_mode="append")
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]


def test_many_comments_share_a_state_value(spark):
    root = scratch_path(spark, f"test-sh-{uuid.uuid4().hex[:8]}")
    known = spark.range(3000).selectExpr("id", "'blog' parent_type", "id % 7 parent_id", "cast(1 + id % 5 as int) rating",
                                         "'pending' status")
    known.selectExpr("id", "cast(null as string) parent_type", "cast(null as long) parent_id", "cast(null as int) rating",
                     "'approved' status", "false deleted", "timestamp '2024-01-20' change_ts", "cast(id as int) seq"
                     ).write.parquet(f"{root}/feed")
    stream = S.read_changes(spark, f"{root}/feed", spark.createDataFrame([], COMMENT).schema)
    n = _state_rows(spark, root, S.rating_deltas(stream, known, shards=16), S.batch_writer(f"{root}/out"))
    got = {r.parent_id: (r.s, r.n) for r in spark.read.parquet(f"{root}/out").groupBy("parent_id").agg(
        F.sum("rating_sum").alias("s"), F.sum("rating_count").alias("n")).collect()}
    assert n == 16
    assert got == {p: (sum(1 + i % 5 for i in range(p, 3000, 7)), len(range(p, 3000, 7))) for p in range(7)}


def test_late_and_withdrawn_writes_of_a_comment(spark):
    def at(m):
        return T0 + dt.timedelta(minutes=m)
    batches = [[(1, "blog", 7, 5, "approved", False, at(2), 1), (2, "blog", 7, 1, "approved", False, at(2), 2)],
               [(1, None, None, None, "pending", False, at(1), 9),  # older than what is known
                (2, None, None, None, "rejected", False, at(3), 1)]]
    root = _stream(spark, batches, COMMENT, S.rating_deltas, lambda r: S.batch_writer(f"{r}/out"))
    got = sorted((r.batch_id, r.rating_sum, r.rating_count) for r in spark.read.parquet(f"{root}/out").collect())
    assert [g[1:] for g in got] == [(1, 1), (5, 1), (-1, -1)]


def test_expiry_equals_the_purge_after_each_batch(spark):
    rng = random.Random(8)
    schema = "id long, token string, expires_at timestamp, is_revoked boolean, created_at timestamp"
    tokens, batches = [], []
    for b in range(4):
        batch = [(b * 50 + i, f"t{i}", None if rng.random() < 0.1 else T0 + dt.timedelta(
            hours=b * 10 + rng.randrange(-3, 25), microseconds=rng.randrange(1000) * 1000), rng.choice([True, False, None]),
            T0 + dt.timedelta(hours=b * 10, seconds=1 + i)) for i in range(20)]
        batches.append(batch)
    batches[1].append((999, "untimed", T0 + dt.timedelta(days=30), False, None))
    roots = []

    def handler(root):
        if not roots:
            roots.append(root)
            BucketedTable.create(spark.createDataFrame([], schema), f"{root}/tokens", "id", 4)
        table = BucketedTable.open(spark, f"{root}/tokens")
        return S.landed_batches(S.bucketed_apply(table, S.apply_token_events(spark.createDataFrame([], schema).schema)),
                                f"{root}/events")

    def compare(i):
        tokens.extend(batches[i])
        as_of = max(t[4] for t in tokens if t[4])
        table = BucketedTable.open(spark, f"{roots[0]}/tokens")
        want = M.purge_tokens(spark.createDataFrame(tokens, schema), as_of)
        # a purge keeps tokens without an expiry only if it is written to do so; the feed keeps them
        kept = {r.id for r in want.collect()} | {t[0] for t in tokens if t[2] is None and not t[3]}
        assert {r.id for r in table.read().collect()} == kept, i
        assert table.read().join(spark.createDataFrame(tokens, schema), spark.createDataFrame(tokens, schema).columns,
                                 "left_anti").where("expires_at is not null and is_revoked is not null and created_at is not null").count() == 0
    _stream(spark, batches, schema, S.expiring_tokens, handler, before=compare)


def test_many_tokens_share_a_state_value_and_a_timer(spark):
    root = scratch_path(spark, f"test-ex-{uuid.uuid4().hex[:8]}")
    schema = "id string, token string, expires_at timestamp, is_revoked boolean, created_at timestamp"
    made = spark.range(3000).selectExpr("'k' || id id", "'t' || id token",
                                        f"timestamp '{T0}' + make_interval(0, 0, 0, 0, cast(id % 30 as int)) expires_at",
                                        "false is_revoked", f"timestamp '{T0}' created_at")
    made.write.parquet(f"{root}/feed")
    stream = S.read_changes(spark, f"{root}/feed", spark.createDataFrame([], schema).schema)
    job = S.expiring_tokens(stream, shards=16)
    # a value, a timer and its place in the order of times for each shard
    assert _state_rows(spark, root, job, S.batch_writer(f"{root}/out")) <= 3 * 16
    for hours in (10, 20, 25):  # the watermark moves on by hours; a token expires once, and not before
        spark.createDataFrame([(f"new{hours}", "x", None, False, T0 + dt.timedelta(hours=hours))], schema).write.mode(
            "append").parquet(f"{root}/feed")
        _state_rows(spark, root, job, S.batch_writer(f"{root}/out"))
        events = spark.read.parquet(f"{root}/out")
        gone = sorted(r.id for r in events.where("expired").collect())
        assert gone == sorted(f"k{i}" for i in range(3000) if i % 30 < hours), hours
    assert events.where("not expired").count() == 3003


def test_batch_writer_is_idempotent(spark):
    root = scratch_path(spark, f"test-idem-{uuid.uuid4().hex[:8]}")
    handle = S.batch_writer(f"{root}/out")
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    handle(df, 0)
    handle(df, 0)  # a retried batch rewrites the same output
    assert spark.read.parquet(f"{root}/out").count() == 5
