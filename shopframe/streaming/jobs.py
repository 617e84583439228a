"""Structured Streaming jobs.

The source updates ratings, counters and tables one request at a time
(triggers and per-request queries). Here each is a streaming query over a
change feed directory:

* aggregates keep their state in the state store and emit updated rows
  (update mode) to ``foreachBatch``; a batch writes its rows under its
  batch id, so a retried batch overwrites its own output (idempotent),
  and the latest row per key across batches is the current value;
* table changes are applied per micro-batch with the batch operators of
  ``operators.changes`` and written as a new table version per batch.

Event times from the test data are ``timestamp_ntz``; watermarks need
``timestamp``, so every job casts first.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes as M
from ..operators import metrics as A
from ..sources.buckets import BucketedTable
from ..sources.tables import read_version, write_version

DEFAULT_WATERMARK = "1 hour"          # T7: lateness covered; older window state is evicted
REQUEST_LIMIT = 1500                  # Fixed value: requests per client per window
REQUEST_WINDOW = "15 minutes"         # Fixed value: request-limit window
CODE_LIMIT = 5                        # Fixed value: verification codes per hour


# ---------------------------------------------------------------- S6 / S7
def read_changes(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None,
                 ts_col: str | None = None) -> DataFrame:
    """A change feed as a streaming DataFrame over a parquet directory."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.parquet(path)
    if ts_col:
        df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return df


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Jobs with several state variables and timers (``transformWithStateInPandas``) need this state store."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                output_mode: str = "update", available_now: bool = True, name: str | None = None):
    """Drive ``handler(batch_df, batch_id)`` with a checkpointed
    ``foreachBatch`` sink; ``available_now`` processes what is there and stops."""
    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(handler)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def batch_writer(out_dir: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that writes each batch's rows under ``batch_id=<n>``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{out_dir.rstrip('/')}/batch_id={batch_id}")
    return handle


def current_state(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """Latest emitted row per key over all written batches (update-mode output)."""
    df = spark.read.parquet(out_dir)
    rest = [c for c in df.columns if c not in keys and c != "batch_id"]
    latest = F.max_by(F.struct(*rest), F.col("batch_id")).alias("__row")
    return df.groupBy(*keys).agg(latest).select(*keys, "__row.*")


# ---------------------------------------------------------------- T1
def rating_sums_stream(comments: DataFrame) -> DataFrame:
    """Running approved-rating sum and count per parent (update mode)."""
    return A.approved_rating_sums(comments)


def ratings_from_state(state: DataFrame) -> DataFrame:
    return state.select("parent_type", "parent_id", F.col("rating_count").alias("n_ratings"),
                        A.rating_average(F.col("rating_sum"), F.col("rating_count")).alias("average_rating"))


# ---------------------------------------------------------------- T2 / T3 / T7
def request_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", window: str = REQUEST_WINDOW,
                   limit: int = REQUEST_LIMIT, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Requests per client per clock-aligned tumbling window, with
    ``over_limit = n > limit``.

    T7: the watermark bounds the state: windows ending before it are
    evicted. Spark guarantees that rows within the delay are counted; rows
    older than the watermark may be dropped or may still be counted into a
    window that is then evicted, so the delay must cover the feed's lateness.
    """
    return (events.withWatermark(ts, watermark)
                  .groupBy(F.col(key), F.window(F.col(ts), window).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                          (F.col("n") > F.lit(limit)).alias("over_limit")))


def sliding_counts(events: DataFrame, key: str = "user_id", ts: str = "created_at", length: str = "1 hour",
                   slide: str = "5 minutes", limit: int = CODE_LIMIT, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Codes per user in sliding windows, flag at ``n >= limit``.
    The exact per-request form is ``windows.trailing_count`` (W2)."""
    return (events.withWatermark(ts, watermark)
                  .groupBy(F.col(key), F.window(F.col(ts), length, slide).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                          (F.col("n") >= F.lit(limit)).alias("at_limit")))


# ---------------------------------------------------------------- T3 exact (Q37): rate limit over accepted requests
def rate_limited(requests: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = CODE_LIMIT,
                 window_seconds: int = 3600, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Q37 exactly: a request is accepted when fewer than ``limit`` *accepted* requests of the same key lie in
    ``(ts - window, ts]``; a refused request records nothing.

    The rule is a recurrence in event-time order, and a feed may bring requests in any order within the watermark's
    delay. So a key's state is a list of the requests that are not decided yet and a list of the accepted times still
    inside the window. A request is decided by an event-time timer once the watermark has passed it, when no earlier
    request can come any more; the timer of the last accepted time plus the window drops a key that stays silent. (The
    store's own time-to-live follows the clock, not event time, so timers expire the state.) The state of a key is
    bounded by its requests within the delay and ``limit``. Rows later than the delay are dropped by Spark and in no
    output. Requests without a time are refused at once. Rows without a key are no requests and only move the
    watermark: the row of ``close_feed`` decides what is pending at the end of a feed. Start the job inside ``keyed_state``.
    Output: (key, ts, accepted, recent = accepted requests in the window before this one).
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    window, key_name = int(window_seconds) * 1_000_000, key
    key_type = requests.schema[key].dataType.simpleString()

    class Limiter(StatefulProcessor):
        """Nested, so that workers need no copy of this package."""

        def init(self, handle):
            self.handle = handle
            self.pending = handle.getListState("pending", "us long")
            self.accepted = handle.getListState("accepted", "us long")

        @staticmethod
        def _list(state):
            return [r[0] for r in state.get()] if state.exists() else []

        def _timer(self, times):
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if times:
                self.handle.registerTimer(-(-min(times) // 1000) + 1)

        def handleInputRows(self, key, rows, timerValues):
            new = [int(t) for pdf in rows for t in pdf["us"].tolist()]
            if key[0] and new:
                pending = sorted([*self._list(self.pending), *new])
                self.pending.put([(t,) for t in pending])
                self._timer(pending)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            pending, kept, out = self._list(self.pending), self._list(self.accepted), []
            due = sorted(t for t in pending if t < passed)
            left = [t for t in pending if t >= passed]
            for t in due:
                kept = [x for x in kept if x > t - window]
                out.append((key[0][1:], t, len(kept) < limit, len(kept)))
                if out[-1][2]:
                    kept.append(t)
            kept = [x for x in kept if x + window > passed]
            for state, values in ((self.pending, left), (self.accepted, kept)):
                state.put([(t,) for t in values]) if values else state.clear()
            self._timer(left or [max(kept) + window] if left or kept else [])
            yield pd.DataFrame({key_name: pd.Series([o[0] for o in out], dtype="object"), "us": [o[1] for o in out],
                                "accepted": [o[2] for o in out], "recent": [o[3] for o in out]})

        def close(self):
            pass

    timed = requests.select(F.col(key), F.col(ts).cast("timestamp").alias(ts))
    schema = f"`{key}` string, us long, accepted boolean, recent long"
    # keys travel as text that is never null; the empty one only moves the watermark
    shown = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    out = (timed.where(F.col(ts).isNotNull()).withWatermark(ts, watermark)
                .select(shown.alias("shown"), ts, F.unix_micros(F.col(ts)).alias("us"))
                .groupBy("shown").transformWithStateInPandas(Limiter(), schema, "append", "EventTime"))
    decided = out.select(F.col(key).cast(key_type).alias(key), F.timestamp_micros("us").alias("ts"), "accepted", "recent")
    return decided.unionByName(timed.where(F.col(ts).isNull()).select(
        key, F.col(ts).alias("ts"), F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("recent")))


def close_feed(feed: DataFrame, ts: str, after: str) -> DataFrame:
    """One row like those of ``feed``, all null but its time, which lies ``after`` (an interval) the last one."""
    last = feed.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).cast(feed.schema[ts].dataType).alias(ts))
    return M.conform(last, feed)


# ---------------------------------------------------------------- T4 / T5
def versioned_apply(base_dir: str, apply: Callable[[DataFrame, DataFrame, int], DataFrame],
                    initial_version: int = 0) -> Callable[[DataFrame, int], None]:
    """T5: ``foreachBatch`` handler applying a batch of changes to a table.

    Version ``v`` of the table lives in ``base_dir/v=<v>``; batch ``b``
    reads version ``initial_version + b`` and writes version
    ``initial_version + b + 1``. A retried batch recomputes the same
    version from the same inputs and overwrites only that directory.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        src = initial_version + batch_id
        base = read_version(spark, base_dir, src)
        write_version(apply(base, batch, batch_id), base_dir, src + 1)
    return handle


def bucketed_apply(table: BucketedTable, change: Callable[[DataFrame, DataFrame], DataFrame],
                   key: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """T5: ``foreachBatch`` handler that rewrites only the buckets which a batch's keys touch. A batch that comes again
    after its commit, in this or a later driver, is skipped; one that died before starts from the same version."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id, change, key)
    return handle


# ---------------------------------------------------------------- T1 with withdrawals
DELTA = "parent_type string, parent_id string, rating_sum long, rating_count long"
SHARDS = 4096                         # groups that share one state value: some thousand keys in each


def _shard(key: str, shards: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(int(shards))).cast("int").alias("shard")


def rating_deltas(changes: DataFrame, known: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Signed changes of the approved-rating sums, from the old and the new image of each changed comment.

    ``changes(id, parent_type, parent_id, rating, status, deleted, change_ts, seq)`` is a feed of comment writes: a null
    field keeps its value, ``deleted`` removes the comment. The state of a comment is its last image, so a status that
    moves away from approved, a changed rating, a moved and a deleted comment all take back what they gave, without a
    read of the comments. Writes without an id are ignored. Writes of one comment are ordered by (change_ts, seq) inside a batch; one that comes in a later
    batch with an older order is ignored (missing orders come first). ``known`` holds the comments from before the feed,
    which are in the sums already (checkpointed, because a plan with subqueries cannot be an initial state).

    Comments are dealt to ``shards`` by a hash of their id. The images of a shard are one state value (JSON, id to
    image), so a batch costs one read and one write of state a touched shard, not a few calls a comment. The number of
    shards belongs to the checkpoint and must stay. Start the job inside ``keyed_state``.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    fields = ["parent_type", "parent_id", "rating", "status"]
    columns = [c.split(" ")[0] for c in DELTA.split(", ")]

    class Images(StatefulProcessor):
        def init(self, handle):
            self.images = handle.getValueState("images", "images string")

        def _read(self):
            return json.loads(self.images.get()[0]) if self.images.exists() else {}

        def _write(self, images):
            self.images.update((json.dumps(images),))

        @staticmethod
        def _counted(image):
            return image is not None and image[3] == "approved" and image[2] is not None

        @staticmethod
        def _rows(pdf, names):
            """The columns' values row by row, whole numbers as int and missing ones as None."""
            def plain(v):
                return None if v is None or v != v or v is pd.NaT else v
            lists = [[plain(v) for v in pdf[c].tolist()] for c in names]
            whole = [i for i, c in enumerate(names) if c in ("rating", "at", "seq")]
            for i in whole:
                lists[i] = [None if v is None else int(v) for v in lists[i]]
            return zip(*lists)

        @staticmethod
        def _place(order):
            return tuple((x is not None, x or 0) for x in order)

        def handleInitialState(self, key, initialState, timerValues):
            images = self._read()
            for name, *values in self._rows(initialState, ["id", *fields]):
                images[name] = [*values, None, None]
            self._write(images)

        def handleInputRows(self, key, rows, timerValues):
            images, writes = self._read(), {}
            for pdf in rows:
                for name, *values, deleted, at, seq in self._rows(pdf, ["id", *fields, "deleted", "at", "seq"]):
                    writes.setdefault(name, []).append((values, bool(deleted or False), (at, seq)))
            out = []
            for name, own in writes.items():
                old = now = images.get(name)
                for values, deleted, order in sorted(own, key=lambda w: self._place(w[2])):
                    if now is not None and self._place(order) < self._place(now[4:]):
                        continue
                    if deleted:
                        now = [None, None, None, "deleted", *order]
                        continue
                    before = now[:4] if now is not None else (None,) * 4
                    now = [*(b if v is None else v for v, b in zip(values, before)), *order]
                images[name] = now
                deltas = [(image[0], image[1], sign * image[2], sign) for image, sign in ((old, -1), (now, 1))
                          if self._counted(image)]
                if not (len(deltas) == 2 and deltas[0][:2] == deltas[1][:2] and deltas[0][2] + deltas[1][2] == 0):
                    out += deltas
            self._write(images)
            yield pd.DataFrame(out, columns=columns)

        def close(self):
            pass

    parent = changes.schema["parent_id"].dataType
    name = F.col("id").cast("string").alias("id")
    images = changes.where("id is not null").select(
        _shard("id", shards), name, "parent_type", F.col("parent_id").cast("string").alias("parent_id"),
        F.col("rating").cast("long").alias("rating"), "status", "deleted",
        F.unix_micros(F.col("change_ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"))
    first = None if known is None else known.where("id is not null").select(
        _shard("id", shards), name, "parent_type", F.col("parent_id").cast("string").alias("parent_id"),
        F.col("rating").cast("long").alias("rating"), "status").checkpoint().groupBy("shard")
    out = images.groupBy("shard").transformWithStateInPandas(Images(), DELTA, "append", "None", initialState=first)
    return out.withColumn("parent_id", F.col("parent_id").cast(parent))


def add_rating_deltas(sums: DataFrame, deltas: DataFrame) -> DataFrame:
    """Sums and counts of a bucketed table after a batch of deltas; parents without an approved rating leave it."""
    keys = ["parent_type", "parent_id"]
    return (sums.unionByName(deltas.select(*sums.columns)).groupBy(*keys)
                .agg(F.sum("rating_sum").alias("rating_sum"), F.sum("rating_count").alias("rating_count"))
                .where("rating_count <> 0").select(*sums.columns))


def landed_batches(handler: Callable[[DataFrame, int], None], out_dir: str) -> Callable[[DataFrame, int], None]:
    """``handler`` over a stored copy of each batch: it may read the batch several times without running the stateful
    plan again, and the copy is overwritten when a batch is repeated."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        path = f"{out_dir.rstrip('/')}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        handler(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)
    return handle


# ---------------------------------------------------------------- T4 expiring state
# rows travel as JSON with whole microseconds
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def expiring_tokens(tokens: DataFrame, key: str = "id", created: str = "created_at", expires: str = "expires_at",
                    revoked: str = "is_revoked", watermark: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """T4: a feed of inserted tokens as events: (key, expired = false, row) for a token that is inserted live, and
    (key, expired = true, null) once, when the watermark passes its expiry.

    Tokens are dealt to ``shards`` by a hash of their key. A shard's state is one value (JSON: the live keys, and the
    expiries still to come with their keys) and one event-time timer, that of the next expiry. So a batch or a purge
    costs a few calls of state a shard it touches, not a few calls a token, and no pass over the table. The number of
    shards belongs to the checkpoint and must stay.
    The watermark is the latest ``created`` time less the delay, in milliseconds; after a batch's timers have run, the
    live tokens are those of M14 as of the watermark. Tokens without a key, revoked tokens and tokens that are past their expiry on arrival
    give no event; a token without an expiry never expires, and one without a creation time, which has no place in event
    time, is inserted without a timer and left to M14. Start the job inside ``keyed_state``.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    key_name, key_type = key, tokens.schema[key].dataType.simpleString()

    class Expiry(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("tokens", "tokens string")

        def _read(self):
            """The keys that have an expiry to come, and (millisecond at which it is past, key) of all expiries."""
            live, due = json.loads(self.state.get()[0]) if self.state.exists() else ([], [])
            return dict.fromkeys(live), due

        def _write(self, live, due):
            if due:
                self.state.update((json.dumps([list(live), due]),))
            else:
                self.state.clear()

        @staticmethod
        def _events(names, expired, rows):
            return pd.DataFrame({key_name: pd.Series(names, dtype="object"),
                                 "expired": pd.Series([expired] * len(names), dtype="bool"),
                                 "row": pd.Series(rows, dtype="object")})

        def handleInputRows(self, key, rows, timerValues):
            now, names, out, added = timerValues.getCurrentWatermarkInMs() * 1000, [], [], []
            for pdf in rows:
                for name, us, row in zip(pdf["name"].tolist(), pdf["us"].tolist(), pdf["payload"].tolist()):
                    us = None if us is None or us != us else int(us)
                    if us is not None and us < now:
                        continue
                    names.append(name)
                    out.append(row)
                    if us is not None:
                        added.append([us // 1000 + 1, name])
            if added:
                live, due = self._read()
                last = min(d[0] for d in due) if due else None
                due += added
                self._write({**live, **dict.fromkeys(name for _, name in added)}, due)
                first = min(d[0] for d in due)
                if first != last:
                    if last is not None:
                        self.handle.deleteTimer(last)
                    self.handle.registerTimer(first)
            yield self._events(names, False, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs()
            live, due = self._read()
            gone = []
            for at, name in sorted(due):
                if at <= passed and name in live:
                    del live[name]
                    gone.append(name)
            due = [d for d in due if d[0] > passed]
            self._write(live, due)
            if due:
                self.handle.registerTimer(min(d[0] for d in due))
            yield self._events(gone, True, [None] * len(gone))

        def close(self):
            pass

    row = F.to_json(F.struct(*[F.col(c) for c in tokens.columns]), JSON_TIMES)
    valid = tokens.where(F.col(key).isNotNull() & ~F.coalesce(F.col(revoked), F.lit(False)))
    untimed = valid.where(F.col(created).isNull()).select(F.col(key), F.lit(False).alias("expired"), row.alias("row"))
    live = valid.where(F.col(created).isNotNull()).select(
        _shard(key, shards), F.col(key).cast("string").alias("name"), F.col(created).cast("timestamp").alias("made"),
        F.unix_micros(F.col(expires).cast("timestamp")).alias("us"), row.alias("payload"))
    events = live.withWatermark("made", watermark).groupBy("shard").transformWithStateInPandas(
        Expiry(), f"`{key}` string, expired boolean, row string", "append", "EventTime")
    return events.withColumn(key, F.col(key).cast(key_type)).unionByName(untimed)


def apply_token_events(schema: T.StructType, key: str = "id") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The rows of touched buckets after a batch of ``expiring_tokens`` events."""
    def change(rows: DataFrame, events: DataFrame) -> DataFrame:
        added = events.where("not expired").select(F.from_json("row", schema, JSON_TIMES).alias("r")).select("r.*")
        gone = events.where("expired").select(F.col(key).alias("__gone"))
        return rows.unionByName(added).join(gone, F.col(key) == F.col("__gone"), "left_anti")
    return change


def expire_tokens_batch(tokens: DataFrame, new_tokens: DataFrame, batch_id: int) -> DataFrame:
    """T4: insert the batch's tokens, then purge expired or revoked ones as of
    the batch's latest event time (the source purges on every insert)."""
    merged = tokens.unionByName(M.conform(new_tokens, tokens))
    as_of = new_tokens.agg(F.max("created_at")).first()[0]
    return merged if as_of is None else M.purge_tokens(merged, as_of)


def patch_users_batch(fields: list[str]) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """T5 for user profile changes: M2 (null keeps) per batch, in (change_ts, seq) order."""
    def apply(base: DataFrame, batch: DataFrame, batch_id: int) -> DataFrame:
        return M.patch_coalesce(base, batch, "id", fields)
    return apply


# ---------------------------------------------------------------- T6
def enrich_comments(comments: DataFrame, users: DataFrame, products: DataFrame, blogs: DataFrame) -> DataFrame:
    """Stream-static left joins: author names and parent name/title."""
    u = users.select(F.col("id").alias("__uid"), F.col("first_name").alias("author_first_name"),
                     F.col("last_name").alias("author_last_name"))
    p = products.select(F.col("id").alias("__pid"), F.col("name").alias("parent_name"))
    b = blogs.select(F.col("id").alias("__bid"), F.col("title").alias("parent_title"))
    out = comments.join(u, comments["user_id"] == u["__uid"], "left")
    out = out.join(p, (F.col("parent_type") == "product") & (F.col("parent_id") == F.col("__pid")), "left")
    out = out.join(b, (F.col("parent_type") == "blog") & (F.col("parent_id") == F.col("__bid")), "left")
    return out.drop("__uid", "__pid", "__bid")


# ---------------------------------------------------------------- feed preparation (test harness)
class Feed:
    """A table dealt out as a change feed of ``parts`` slices in event-time order (rows without a time come first).

    Every slice is written in parallel and processed by a run of its own over the same checkpoint, so a job sees
    several micro-batches, oldest first, and continues from its checkpoint each time.
    """

    def __init__(self, df: DataFrame, ts_col: str, root: str, parts: int = 3):
        self.root, self.path, self.parts = root, f"{root}/feed", parts
        t = F.unix_micros(F.col(ts_col).cast("timestamp"))
        lo, hi = df.agg(F.min(t), F.max(t)).first()
        width = 1 if lo is None else max(1, (hi - lo) // parts + 1)
        first = F.lit(0 if lo is None else lo)
        self._sliced = df.withColumn("__slice", F.coalesce(F.floor((t - first) / F.lit(width)), F.lit(0)))
        self._write(0)
        self.stream = read_changes(df.sparkSession, self.path, df.schema)

    def _write(self, i: int) -> None:
        self._sliced.where(F.col("__slice") == i).drop("__slice").write.mode("append").parquet(self.path)

    def run(self, stream: DataFrame, handler: Callable[[DataFrame, int], None], output_mode: str = "update") -> None:
        """Process slice after slice of the feed with ``stream`` (a plan over ``self.stream``)."""
        for i in range(self.parts):
            if i:
                self._write(i)
            run_batches(stream, handler, f"{self.root}/ckpt", output_mode)
