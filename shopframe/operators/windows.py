"""Per-key ordering operators.

The source model answers these for one key at a time; here they run for
all keys at once. Where a per-key window would put a hot key's rows into
one task, the operator is phrased so the shuffle key is finer than the
business key (aggregates with map-side combine, or key + time bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000


# ---------------------------------------------------------------- W1
def latest_per(df: DataFrame, key: str | Sequence[str], order: Sequence[str] = ("created_at", "id"),
               newest: bool = True) -> DataFrame:
    """The newest (or oldest) row per key by ``order``.

    A ``max_by`` aggregate: partial aggregation keeps one candidate per key
    per task before the shuffle, so a key with millions of rows costs one
    row of network traffic per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    packed = pick(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, "__row.*")


# ---------------------------------------------------------------- W2
def _micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def _prefix_counts(rows: DataFrame, key: str, w_us: int, as_: str, rows_per_range: int) -> DataFrame:
    """``rows`` with ``as_``, the rows of the same key with __t in (__t - w, __t], by differences of prefix counts.

    Every row stands in one order of (key, time) three times: as itself, as a probe behind its own time and as a probe
    behind the lower end of its window. The number of rows before a probe is the total of the ranges before its own
    and a running count inside it; the difference of a row's two probes is its window, and what lies before the key
    cancels out. Ranges are cut anywhere, also inside one key and one moment, so no task depends on a key's size.
    """
    rows = rows.withColumn("__id", F.monotonically_increasing_id()).checkpoint()

    def events(at: Column, kind: int) -> DataFrame:
        return rows.select(F.col(key).alias("__key"), at.alias("__at"), F.lit(min(kind, 1)).alias("__kind"), "__id",
                           F.lit(int(kind == 0)).cast("long").alias("__own"), F.lit((0, 1, -1)[kind]).alias("__sign"))

    every = events(F.col("__t"), 0).unionByName(events(F.col("__t"), 1)).unionByName(events(F.col("__t") - w_us, 2))
    order = ["__key", "__at", "__kind", "__id", "__sign"]
    ranges = max(1, -(-every.count() // rows_per_range))
    dealt = every.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("__range").agg(F.sum("__own").alias("__n"))  # one row a range
    before = totals.select("__range", F.coalesce(F.sum("__n").over(
        Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    running = F.sum("__own").over(Window.partitionBy("__range").orderBy(*order)
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    probes = dealt.withColumn("__running", running).where("__kind = 1").join(before, "__range")
    counts = probes.groupBy("__id").agg(
        F.sum(F.col("__sign") * (F.col("__running") + F.col("__before"))).cast("bigint").alias(as_))
    return rows.join(counts, "__id").drop("__id")


def trailing_count(df: DataFrame, key: str, ts: str, window_seconds: int, limit: int | None = None,
                   as_: str = "n_in_window", hot_rows: int | None = None,
                   rows_per_range: int = 1_000_000) -> DataFrame:
    """For every row, the number of rows of the same key in ``(ts - window, ts]``.

    The lower bound is strict: a row exactly one window old is out. A row
    without a time is in no window and counts 0. With
    ``limit``, ``blocks_next = n >= limit`` tells whether the next request
    after this row would be refused.

    Skew-safe and exact: rows are bucketed by ``floor(ts / window)``. A
    row's window can only reach back into its own and the previous bucket,
    so each row is also copied into the next bucket as context. The range
    window is partitioned by (key, bucket), spreading a hot key over time,
    and counts context rows while only the bucket's own rows are kept.
    With ``hot_rows``, buckets of one key that hold more rows than that are
    counted by prefix counts over ranges of about ``rows_per_range`` events
    instead, so that a key with all its rows inside one window is spread too.
    """
    w_us = int(window_seconds) * MICROS_PER_SECOND
    base = df.withColumn("__t", _micros(ts))
    untimed = base.where(F.col("__t").isNull()).drop("__t").withColumn(as_, F.lit(0).cast("bigint"))
    base = base.where(F.col("__t").isNotNull()).withColumn("__b", F.floor(F.col("__t") / F.lit(w_us)).cast("bigint"))
    spread = None
    if hot_rows is not None:
        big = base.groupBy(F.col(key).alias("__hk"), F.col("__b").alias("__hb")).count().where(F.col("count") > hot_rows)
        # a bucket is hot if it or the one before, which its windows reach into, holds that many rows
        hot = big.select("__hk", "__hb").unionByName(big.select("__hk", (F.col("__hb") + 1).alias("__hb"))).distinct().checkpoint()
        if not hot.isEmpty():
            def here(bucket):
                return F.col(key).eqNullSafe(F.col("__hk")) & (bucket == F.col("__hb"))
            marked = base.join(hot.withColumn("__hot", F.lit(True)), here(F.col("__b")), "left").drop("__hk", "__hb")
            needed = marked.join(hot, here(F.col("__b") + 1), "left_semi").where("__hot is null").unionByName(
                marked.where("__hot"))
            spread = _prefix_counts(needed, key, w_us, as_, rows_per_range).where("__hot").drop("__hot", "__t", "__b")
            base = marked.drop("__hot")
            cold = hot.withColumn("__skip", F.lit(True))
    own = base.withColumn("__own", F.lit(True))
    ctx = base.withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False))
    both = own.unionByName(ctx)
    if spread is not None:
        both = both.join(cold, here(F.col("__b")), "left").where("__skip is null").drop("__skip", "__hk", "__hb")
    win = (Window.partitionBy(key, "__b").orderBy("__t").rangeBetween(-(w_us - 1), 0))
    counted = both.withColumn(as_, F.count(F.lit(1)).over(win)).where(F.col("__own"))
    out = counted.drop("__t", "__b", "__own").unionByName(untimed)
    out = out if spread is None else out.unionByName(spread)
    if limit is not None:
        out = out.withColumn("blocks_next", F.col(as_) >= F.lit(int(limit)))
    return out


# ---------------------------------------------------------------- W3 / W4 (images)
def promote_main_after_delete(images: DataFrame, deleted_ids: DataFrame, id_col: str = "id",
                              key: str = "product_id", flag: str = "is_main") -> DataFrame:
    """Delete images and keep one main image per touched product.

    Products that lost their main image and have no main image left get
    their smallest-id remaining image as main. Two partial aggregates per
    product; no per-product sort.
    """
    dels = deleted_ids.select(F.col(id_col).alias("__del")).distinct()
    gone = images.join(dels, images[id_col] == dels["__del"], "left_semi")
    lost_main = gone.where(F.col(flag)).select(F.col(key).alias("__p")).distinct()
    left = images.join(dels, images[id_col] == dels["__del"], "left_anti")
    state = (left.join(lost_main, left[key] == lost_main["__p"], "left_semi")
                 .groupBy(F.col(key).alias("__p2"))
                 .agg(F.max(F.col(flag).cast("int")).alias("__has"), F.min(id_col).alias("__first")))
    promote = state.where(F.col("__has") == 0).select("__first")
    out = left.join(promote, left[id_col] == promote["__first"], "left")
    return out.withColumn(flag, F.when(F.col("__first").isNotNull(), F.lit(True)).otherwise(F.col(flag))).drop("__first")


def flag_first_uploads(images: DataFrame, uploads: DataFrame, key: str = "product_id",
                       order: Sequence[str] = ("change_ts", "seq"), flag: str = "is_main",
                       owners: DataFrame | None = None, requester_col: str = "requester_id") -> DataFrame:
    """New image rows with ``is_main`` set on the first upload of products that
    had no image (W4): ``row_number() == 1`` among the product's uploads and
    an existing-image count (left join, J14) of 0.

    With ``owners(id, owner_id)`` only uploads by the product's owner are
    kept (the source joins the seller and checks its user)."""
    if owners is not None:
        o = owners.select(F.col("id").alias("__oid"), F.col("owner_id").alias("__own"))
        uploads = uploads.join(o, (uploads[key] == F.col("__oid")) & (uploads[requester_col] == F.col("__own")),
                               "left_semi")
    existing = images.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    # The first upload per product is found with a min aggregate (combined
    # map-side), not a per-product window; order keys are unique per upload.
    first = uploads.groupBy(F.col(key).alias("__f")).agg(F.min(F.struct(*order)).alias("__first"))
    up = uploads.join(first, uploads[key] == first["__f"], "left")
    up = up.join(existing, up[key] == existing["__k"], "left")
    is_first = (F.struct(*order) == F.col("__first")) & (F.coalesce(F.col("__n"), F.lit(0)) == 0)
    return up.withColumn(flag, is_first).drop("__f", "__first", "__k", "__n")


# ---------------------------------------------------------------- W5 (addresses)
def apply_exclusive_flag(rows: DataFrame, requests: DataFrame, owner: str = "user_id", id_col: str = "id",
                         flag: str = "is_default", order: Sequence[str] = ("change_ts", "seq"),
                         as_of=None, touched_col: str | None = "updated_at") -> DataFrame:
    """Make one row per owner the flagged one.

    ``requests(owner, id_col, change_ts, seq)``: requests naming a row the
    owner does not have are refused (the source rolls them back), then the
    owner's last valid request wins. Owners with no valid request keep
    their rows unchanged. With ``as_of`` the chosen row's ``updated_at`` is
    touched (M15).
    """
    valid = requests.join(rows.select(F.col(owner).alias("__o"), F.col(id_col).alias("__i")),
                          (requests[owner] == F.col("__o")) & (requests[id_col] == F.col("__i")), "left_semi")
    chosen = latest_per(valid.select(owner, id_col, *order), owner, order).select(
        F.col(owner).alias("__owner"), F.col(id_col).alias("__chosen"))
    out = rows.join(chosen, rows[owner] == chosen["__owner"], "left")
    hit = F.col("__owner").isNotNull()
    out = out.withColumn(flag, F.when(hit, F.col(id_col) == F.col("__chosen")).otherwise(F.col(flag)))
    if as_of is not None and touched_col and touched_col in rows.columns:
        out = out.withColumn(touched_col, F.when(hit & (F.col(id_col) == F.col("__chosen")),
                                                 F.lit(as_of).cast(rows.schema[touched_col].dataType))
                             .otherwise(F.col(touched_col)))
    return out.drop("__owner", "__chosen")
