"""Streaming job registrations.

Each query deals its change feed (derived by Spark from the test tables)
out as several time-ordered slices into a fresh folder under the session's
checkpoint directory, runs the streaming job over each slice with
``availableNow`` from the same checkpoint (so state carries across batches
and restarts), and returns the sink's final state for comparison with the
batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.metrics import approved_rating_sums
from ..schemas import ENUMS
from ..session import scratch_path
from ..sources.buckets import BucketedTable
from ..streaming import jobs as S
from .registry import register, tables


def _naive_windows(df):
    """The feeds' event times are naive (timestamp_ntz); report window bounds the same way."""
    return (df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
              .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


def _run_dir(spark, name: str) -> str:
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def _feed(spark, df, ts_col: str, name: str):
    feed = S.Feed(df, ts_col, _run_dir(spark, name), parts=3)
    return feed, feed.root, feed.stream


@register("stream_ratings")
def q_stream_ratings(spark, sf_dir):
    comments = tables(spark, sf_dir)["comments"]
    feed, root, stream = _feed(spark, comments, "created_at", "ratings")
    feed.run(S.rating_sums_stream(stream), S.batch_writer(f"{root}/out"))
    state = S.current_state(spark, f"{root}/out", ["parent_type", "parent_id"])
    return S.ratings_from_state(state)


@register("stream_window_counts")
def q_stream_window_counts(spark, sf_dir):
    events = tables(spark, sf_dir).raw("events")
    feed, root, stream = _feed(spark, events, "ts", "requests")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    feed.run(S.request_counts(stream), S.batch_writer(f"{root}/out"))
    return _naive_windows(S.current_state(spark, f"{root}/out", ["user_id", "window_start"]))


@register("stream_sliding_attempts")
def q_stream_sliding_attempts(spark, sf_dir):
    codes = tables(spark, sf_dir)["email_verifications"]
    feed, root, stream = _feed(spark, codes, "created_at", "codes")
    stream = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    feed.run(S.sliding_counts(stream), S.batch_writer(f"{root}/out"))
    return _naive_windows(S.current_state(spark, f"{root}/out", ["user_id", "window_start"]))


@register("stream_rate_limited_codes")
def q_stream_rate_limited_codes(spark, sf_dir):
    """Q37 exact over the verification-code requests: at most 5 accepted per
    user in any trailing day (the one-hour rule never binds on the test data)."""
    codes = tables(spark, sf_dir)["email_verifications"].select("user_id", F.col("created_at").alias("ts"))
    codes = codes.unionByName(S.close_feed(codes, "ts", "1 DAY"))
    feed, root, stream = _feed(spark, codes, "ts", "ratelimit")
    with S.keyed_state(spark):
        feed.run(S.rate_limited(stream, window_seconds=86400), S.batch_writer(f"{root}/out"), output_mode="append")
    return (spark.read.parquet(f"{root}/out").drop("batch_id")
                 .withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@register("stream_apply_changes")
def q_stream_apply_changes(spark, sf_dir):
    t = tables(spark, sf_dir)
    feed, root, stream = _feed(spark, t["user_changes"], "change_ts", "user-changes")
    users = BucketedTable.create(t["users"], f"{root}/users", "id", buckets=16)
    patch = S.patch_users_batch(["first_name", "last_name"])
    feed.run(stream, S.bucketed_apply(users, lambda rows, batch: patch(rows, batch, 0)), output_mode="append")
    return users.read()


@register("stream_moderation")
def q_stream_moderation(spark, sf_dir):
    t = tables(spark, sf_dir)
    feed, root, stream = _feed(spark, t["comment_moderation"], "change_ts", "moderation")
    known = t["comments"].select("id", "parent_type", "parent_id", "rating", "status")
    sums = BucketedTable.create(approved_rating_sums(known), f"{root}/sums", ["parent_type", "parent_id"], buckets=16)
    kinds = {f.name: f.dataType for f in known.schema}
    changes = stream.where(F.col("status").isin(ENUMS["comment_status"])).select(
        F.col("comment_id").cast(kinds["id"]).alias("id"), F.lit(None).cast("string").alias("parent_type"),
        F.lit(None).cast(kinds["parent_id"]).alias("parent_id"), F.lit(None).cast("long").alias("rating"), "status",
        F.lit(False).alias("deleted"), "change_ts", "seq")
    handler = S.landed_batches(S.bucketed_apply(sums, S.add_rating_deltas), f"{root}/deltas")
    with S.keyed_state(spark):
        feed.run(S.rating_deltas(changes, known), handler, output_mode="append")
    return S.ratings_from_state(sums.read())


@register("stream_expiry")
def q_stream_expiry(spark, sf_dir):
    tokens = tables(spark, sf_dir)["refresh_tokens"]
    feed, root, stream = _feed(spark, tokens, "created_at", "tokens")
    live = BucketedTable.create(tokens.limit(0), f"{root}/tokens", "id", buckets=16)
    handler = S.landed_batches(S.bucketed_apply(live, S.apply_token_events(tokens.schema)), f"{root}/events")
    with S.keyed_state(spark):
        feed.run(S.expiring_tokens(stream), handler, output_mode="append")
    return live.read()


@register("stream_enrich")
def q_stream_enrich(spark, sf_dir):
    t = tables(spark, sf_dir)
    feed, root, stream = _feed(spark, t["comments"], "created_at", "enrich")
    enriched = S.enrich_comments(stream, t["users"], t["products"], t["blogs"])
    feed.run(enriched, S.batch_writer(f"{root}/out"), output_mode="append")
    return spark.read.parquet(f"{root}/out").drop("batch_id")
