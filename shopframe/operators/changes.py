"""Change application.

Every operator is ``(base, changes, ...) -> new base`` (plus rejected
requests where the source refuses some), built from joins, anti joins and
unions; parquet has no MERGE, so callers write the new base to a new
location (``sources.tables.write_version``).

Changes carry ``(change_ts, seq)``. The source applies requests one at a
time; a batch is reduced so the result equals that serial order: field
values are chosen with ``max_by`` over the order key, which is a partial
aggregate, so a key with a huge number of changes is combined map-side.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULTS, ENUMS
from .serial import ORDER as TOTAL
from .serial import accepted, decide_claims, decide_patches, in_total_order, reasons
from .windows import latest_per

ORDER = ("change_ts", "seq")


def _order(order: Sequence[str] = ORDER) -> Column:
    return F.struct(*[F.col(c) for c in order])


def new_key(key_type: T.DataType, namespace: str, *cols: str | Column) -> Column:
    """Deterministic key for a created row, so a retried batch yields the same keys.

    Integral key columns get the first 60 bits of ``md5('ns:v1:v2..')`` (a
    positive bigint); text keys get the sha-256 hex of the same string, and
    are the form for tables beyond some hundred million rows, where 60 bits
    begin to clash (``key_clashes`` shows it). Narrower integers are refused.
    Both forms are plain SQL functions, reproducible outside Spark. A null
    value is written as ``<null>``, so it never shifts the others.
    """
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("<null>")) for c in cols]
    text = F.concat_ws(":", F.lit(namespace), *parts)
    if isinstance(key_type, T.LongType):
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    if isinstance(key_type, T.StringType):
        return F.sha2(text, 256)
    raise ValueError(f"derived keys need a bigint or text column, not {key_type.simpleString()}")


def request_key(ts: str = "change_ts", seq: str = "seq") -> list[Column]:
    """What tells requests apart: time in microseconds and number (a number alone may start anew in each batch)."""
    return [F.unix_micros(F.col(ts).cast("timestamp")), F.col(seq)]


def key_clashes(base: DataFrame, inserted: DataFrame, key: str = "id") -> DataFrame:
    """(key, rows) of inserted keys that stand in ``base`` or more than once in ``inserted``."""
    new = inserted.select(F.col(key).alias("key"))
    old = base.select(F.col(key).alias("key")).join(new.distinct(), "key", "left_semi")
    return new.unionByName(old).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")


def touch(df: DataFrame, changed: Column, as_of, col: str = "updated_at") -> DataFrame:
    """Set ``updated_at`` on changed rows (only if the table has it)."""
    if col not in df.columns or as_of is None:
        return df
    return df.withColumn(col, F.when(changed, F.lit(as_of).cast(df.schema[col].dataType)).otherwise(F.col(col)))


def conform(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Cast/arrange ``rows`` to the columns and types of ``like`` (missing -> null)."""
    cols = []
    for f in like.schema.fields:
        if f.name in rows.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*cols)


# ---------------------------------------------------------------- M1
def with_defaults(rows: DataFrame, table: str, as_of=None) -> DataFrame:
    """Fill declared defaults (and created/updated timestamps) on new rows."""
    out = rows
    for col, value in DEFAULTS.get(table, {}).items():
        if col in out.columns:
            out = out.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(out.schema[col].dataType)))
    if as_of is not None:
        for col in ("created_at", "updated_at"):
            if col in out.columns:
                out = out.withColumn(col, F.coalesce(F.col(col), F.lit(as_of).cast(out.schema[col].dataType)))
    return out


def insert(base: DataFrame, new_rows: DataFrame, table: str, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Append rows with defaults; returns (new base, inserted rows)."""
    ins = with_defaults(conform(new_rows, base), table, as_of)
    return base.unionByName(ins), ins


# ---------------------------------------------------------------- M2 / M3
def patch_coalesce(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], as_of=None,
                   order: Sequence[str] = ORDER) -> DataFrame:
    """M2: ``field = COALESCE(new, field)`` applied in change order.

    A null in a change keeps the value, so each field takes its last
    non-null value in the batch. Changes for unknown keys do nothing.
    """
    o = _order(order)
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), o)).alias(f"__new_{f}") for f in fields]
    per_key = changes.groupBy(F.col(key).alias("__key")).agg(*aggs)
    out = base.join(per_key, base[key] == per_key["__key"], "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"__new_{f}").cast(base.schema[f].dataType), F.col(f)))
    out = touch(out, F.col("__key").isNotNull(), as_of)
    return out.drop("__key", *[f"__new_{f}" for f in fields])


def patch_present(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], as_of=None,
                  present_col: str = "present", order: Sequence[str] = ORDER) -> DataFrame:
    """M3: only fields named in the change's ``present`` array are set (null allowed)."""
    o = _order(order)
    aggs = []
    for f in fields:
        has = F.array_contains(F.col(present_col), f)
        aggs.append(F.max_by(F.col(f), F.when(has, o)).alias(f"__new_{f}"))
        aggs.append(F.max(has.cast("int")).alias(f"__has_{f}"))
    per_key = changes.groupBy(F.col(key).alias("__key")).agg(*aggs)
    out = base.join(per_key, base[key] == per_key["__key"], "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"__has_{f}") == 1, F.col(f"__new_{f}").cast(base.schema[f].dataType))
                             .otherwise(F.col(f)))
    out = touch(out, F.col("__key").isNotNull(), as_of)
    return out.drop("__key", *[f"__new_{f}" for f in fields], *[f"__has_{f}" for f in fields])


def patch_unique(base: DataFrame, changes: DataFrame, key: str, unique_cols: Sequence[str], fields: Sequence[str],
                 as_of=None, order: Sequence[str] = ORDER, reset_col: str | None = None,
                 reset_on: str | None = None) -> dict[str, DataFrame]:
    """M2 patches where some columns are each unique (F12), in exact serial order.

    A change is refused when any unique column's new value (null keeps the
    current one) is held by another row at that moment; a value is freed
    when its holder changes it (``serial.decide_patches``). Equal orders are
    decided by a hash of the change and its landed number, missing ones come
    first. With ``reset_col``/``reset_on`` (M22) the flag is cleared when an
    accepted change's ``reset_on`` value is missing or differs from the
    row's value at that moment, that is, when some accepted change lacks it
    or differs from the value before the batch.
    Returns {'base', 'rejected'}.
    """
    judged = decide_patches(base, in_total_order(changes, order), key, [[c] for c in unique_cols])
    reason = F.when(~F.col("__known"), F.lit("not found")).otherwise(reasons([f"{c} in use" for c in unique_cols]))
    rejected = judged.where(~F.col("__known") | ~accepted()).select(*changes.columns, reason.alias("reason"))
    good = judged.where(F.col("__known") & accepted())
    out = patch_coalesce(base, good, key, list(fields), as_of, (TOTAL,))
    if reset_col and reset_on:
        asked = good.groupBy(F.col(key).alias("__r")).agg(
            F.max(F.col(reset_on).isNull()).alias("__missing"), F.min(reset_on).alias("__low"), F.max(reset_on).alias("__high"))
        old = base.select(F.col(key).alias("__k"), F.col(reset_on).alias("__old"))
        asked = asked.join(old, F.col("__r") == F.col("__k")).where(
            F.col("__missing") | ~F.col("__low").eqNullSafe(F.col("__old")) | ~F.col("__high").eqNullSafe(F.col("__old")))
        out = out.join(asked.select("__r"), out[key] == F.col("__r"), "left")
        out = out.withColumn(reset_col, F.when(F.col("__r").isNotNull(), F.lit(False)).otherwise(F.col(reset_col)))
        out = out.drop("__r")
    return {"base": out.select(*base.columns), "rejected": rejected}


def patch_user(users: DataFrame, changes: DataFrame, fields: Sequence[str], as_of=None,
               order: Sequence[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """Q32: profile patch (M2) with conflict check (F12) and email reset.

    In request order, a change whose email or phone is held by *another*
    user at that moment is refused (a value freed earlier in the batch is
    reusable). ``is_verified`` becomes false when an accepted change's email
    differs from the user's email at that moment, a missing email counting as
    different (as in the source). Returns (new users, rejected changes with reason).
    """
    unique = [k for k in ("email", "phone_number") if k in fields]
    res = patch_unique(users, changes, "id", unique, fields, as_of, order,
                       reset_col="is_verified", reset_on="email" if "email" in unique else None)
    return res["base"], res["rejected"]


# ---------------------------------------------------------------- M4 / M5 / M19 / M20 carts
def create_missing_carts(carts: DataFrame, users: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """A cart for every user who has none. Returns (carts, created)."""
    need = users.select(F.col("id").alias("user_id")).join(carts.select("user_id"), "user_id", "left_anti")
    created = need.select(new_key(carts.schema["id"].dataType, "cart", "user_id").alias("id"), "user_id")
    return insert(carts, created, "carts", as_of)


def upsert_cart(carts: DataFrame, cart_items: DataFrame, products: DataFrame, changes: DataFrame,
                as_of=None, order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """M4: add-to-cart requests ``(user_id, product_id, quantity, change_ts, seq)``.

    Refused when the product is unknown or its stock is below the quantity.
    Accepted requests create the user's cart if needed (M19), then either
    *replace* the quantity and refresh the price of the existing line or
    insert a new line at the current price. Stock is never decremented, so
    each request's acceptance is independent of the others and the last
    accepted request per (user, product) is the final state.
    Returns {'carts', 'cart_items', 'rejected'}.
    """
    p = products.select(F.col("id").alias("__pid"), F.col("price").alias("__price"), F.col("stock").alias("__stock"))
    ch = changes.join(p, changes["product_id"] == p["__pid"], "left")
    reason = (F.when(F.col("__pid").isNull(), F.lit("product not found"))
               .when(F.col("__stock") < F.col("quantity"), F.lit("not enough stock")))
    ch = ch.withColumn("reason", reason)
    rejected = ch.where(F.col("reason").isNotNull()).select(*changes.columns, "reason")
    ok = ch.where(F.col("reason").isNull())
    users = ok.select(F.col("user_id").alias("id")).distinct()
    all_carts, _ = create_missing_carts(carts, users, as_of)
    cart_of = all_carts.groupBy(F.col("user_id").alias("__u")).agg(F.min("id").alias("__cart"))
    last = latest_per(ok.select("user_id", "product_id", "quantity", "__price", *order), ["user_id", "product_id"], order)
    lines = last.join(cart_of, last["user_id"] == cart_of["__u"], "inner").select(
        F.col("__cart").alias("cart_id"), "product_id", F.col("quantity").alias("__q"),
        F.col("__price").alias("__p"), F.col(order[0]).alias("__ts"))
    j = cart_items.join(lines, ["cart_id", "product_id"], "full_outer")
    out = j.select(*[
        (F.coalesce(F.col("__q").cast(cart_items.schema["quantity"].dataType), F.col("quantity")).alias("quantity")
         if c == "quantity" else
         F.coalesce(F.col("__p").cast(cart_items.schema["price"].dataType), F.col("price")).alias("price")
         if c == "price" else
         F.coalesce(F.col(c), F.col("__ts").cast(cart_items.schema[c].dataType)).alias(c)
         if c == "created_at" else
         F.coalesce(F.col(c), new_key(cart_items.schema[c].dataType, "cart_item", "cart_id", "product_id")).alias(c)
         if c == "id" else F.col(c))
        for c in cart_items.columns])
    touched = lines.select(F.col("cart_id").alias("__t")).distinct()
    all_carts = all_carts.join(touched, all_carts["id"] == touched["__t"], "left")
    all_carts = touch(all_carts, F.col("__t").isNotNull(), as_of).drop("__t")
    return {"carts": all_carts, "cart_items": out, "rejected": rejected}


def update_cart_quantity(carts: DataFrame, cart_items: DataFrame, products: DataFrame, changes: DataFrame,
                         order: Sequence[str] = ORDER, as_of=None) -> dict[str, DataFrame]:
    """M5: ``(user_id, cart_id, product_id, quantity, change_ts, seq)`` on existing lines.

    Refused when the line is not in one of the user's carts or stock is
    short; accepted ones set the quantity, refresh the price and touch the
    cart (M15). Lines are keyed by (cart_id, product_id).
    Returns {'carts', 'cart_items', 'rejected'}."""
    owned = carts.select(F.col("id").alias("__c"), F.col("user_id").alias("__u"))
    line = cart_items.select(F.col("cart_id").alias("__lc"), F.col("product_id").alias("__lp"))
    p = products.select(F.col("id").alias("__pid"), F.col("price").alias("__price"), F.col("stock").alias("__stock"))
    ch = (changes.join(owned, (changes["cart_id"] == owned["__c"]) & (changes["user_id"] == owned["__u"]), "left")
                 .join(line, (F.col("cart_id") == F.col("__lc")) & (F.col("product_id") == F.col("__lp")), "left")
                 .join(p, F.col("product_id") == F.col("__pid"), "left"))
    reason = (F.when(F.col("__c").isNull() | F.col("__lc").isNull() | F.col("__pid").isNull(),
                     F.lit("cart item not found"))
               .when(F.col("__stock") < F.col("quantity"), F.lit("not enough stock")))
    ch = ch.withColumn("reason", reason)
    rejected = ch.where(F.col("reason").isNotNull()).select(*changes.columns, "reason")
    ok = ch.where(F.col("reason").isNull())
    last = latest_per(ok.select("cart_id", "product_id", "quantity", "__price", *order), ["cart_id", "product_id"], order)
    upd = last.select("cart_id", "product_id", F.col("quantity").alias("__q"), F.col("__price").alias("__p"))
    j = cart_items.join(upd, ["cart_id", "product_id"], "left")
    out = j.withColumn("quantity", F.coalesce(F.col("__q").cast(cart_items.schema["quantity"].dataType), F.col("quantity"))) \
           .withColumn("price", F.coalesce(F.col("__p").cast(cart_items.schema["price"].dataType), F.col("price"))) \
           .drop("__q", "__p")
    changed = upd.select(F.col("cart_id").alias("__t")).distinct()
    touched = carts.join(changed, carts["id"] == changed["__t"], "left")
    touched = touch(touched, F.col("__t").isNotNull(), as_of).drop("__t")
    return {"carts": touched, "cart_items": out.select(*cart_items.columns), "rejected": rejected}


def clear_carts(carts: DataFrame, cart_items: DataFrame, requests: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Remove every line of the requesting users' carts and touch the carts."""
    req = requests.select(F.col("user_id").alias("__u")).distinct()
    hit = carts.join(req, carts["user_id"] == req["__u"], "left_semi").select(F.col("id").alias("__c"))
    items = cart_items.join(hit, cart_items["cart_id"] == hit["__c"], "left_anti")
    c = carts.join(hit, carts["id"] == hit["__c"], "left")
    c = touch(c, F.col("__c").isNotNull(), as_of).drop("__c")
    return {"carts": c, "cart_items": items}


# ---------------------------------------------------------------- M6 / M7
def replace_children(child: DataFrame, new_children: DataFrame, parent_fk: str,
                     touched_parents: DataFrame | None = None) -> DataFrame:
    """M6: for every touched parent, drop all its child rows and insert the new set.

    Parents are those in ``new_children`` plus ``touched_parents`` (a parent
    replaced by an empty list has no new rows). Applying it twice equals once.
    """
    t = new_children.select(F.col(parent_fk).alias("__p"))
    if touched_parents is not None:
        t = t.unionByName(touched_parents.select(F.col(parent_fk).alias("__p")))
    t = t.distinct()
    kept = child.join(t, child[parent_fk] == t["__p"], "left_anti")
    return kept.unionByName(conform(new_children, child))


def owned_delete(base: DataFrame, requests: DataFrame, owners: DataFrame, id_col: str = "id",
                 requester_col: str = "requester_id", admin_col: str | None = None) -> dict[str, DataFrame]:
    """M7: delete rows only when the requester owns them (or is an admin).

    ``owners(id, owner_id)`` maps a row to its owner (e.g. product -> seller's
    user). Returns {'base', 'deleted', 'rejected'}."""
    o = owners.select(F.col(id_col).alias("__id"), F.col("owner_id").alias("__owner"))
    r = requests.join(o, requests[id_col] == o["__id"], "left")
    allowed = F.col("__owner").isNotNull() & (F.col("__owner") == F.col(requester_col))
    if admin_col:
        allowed = allowed | (F.col("__id").isNotNull() & F.coalesce(F.col(admin_col), F.lit(False)))
    r = r.withColumn("__ok", F.coalesce(allowed, F.lit(False)))
    dels = r.where(F.col("__ok")).select(F.col(id_col).alias("__d")).distinct()
    rejected = r.where(~F.col("__ok")).select(*requests.columns)
    return {"base": base.join(dels, base[id_col] == dels["__d"], "left_anti"),
            "deleted": base.join(dels, base[id_col] == dels["__d"], "left_semi"),
            "rejected": rejected}


# ---------------------------------------------------------------- M8
def cascade_delete(tables: dict[str, DataFrame], table: str, keys: DataFrame,
                   fks: Sequence[tuple[str, str, str, str]],
                   key_cols: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """M8: delete ``keys`` from ``table`` and follow the foreign-key list.

    ``fks`` rows are (child, fk column, parent, on_delete) with on_delete in
    cascade / set_null / restrict. Key sets are pushed level by level, each
    row carrying the root key that reached it. A root that reaches a row
    under a RESTRICT key is refused as a whole, before anything is deleted.
    A table that gains keys over several paths, or over a cycle, passes its
    new keys on each time, until no table gains any; every level's key set is
    checkpointed, so no level is computed twice.
    Returns the new tables plus '__rejected' (root, reason).
    """
    key_cols = key_cols or {}
    kc = lambda t: key_cols.get(t, "id")
    roots = keys.select(F.col(kc(table)).alias("key"), F.col(kc(table)).alias("root")).distinct().checkpoint()
    reached: dict[str, DataFrame] = {table: roots}
    restricted: list[DataFrame] = []
    nulled: dict[str, list[tuple[str, DataFrame]]] = {}
    frontier: dict[str, DataFrame] = {table: roots}  # keys of each table that were reached for the first time
    while frontier:
        new: dict[str, list[DataFrame]] = {}
        for child, col, par, action in fks:
            if par not in frontier or child not in tables:
                continue
            c = tables[child]
            wanted = frontier[par].select(F.col("key").alias("__pk"), F.col("root").alias("__root"))
            hit = c.join(wanted, c[col] == F.col("__pk"), "inner")
            if action == "restrict":
                restricted.append(hit.select(F.col("__root").alias("root"),
                                             F.lit(f"{child}.{col} references {par}").alias("reason")))
            elif action == "set_null":
                nulled.setdefault(child, []).append((col, hit.select(F.col("__pk").alias("key"), F.col("__root").alias("root"))))
            elif action == "cascade":
                if kc(child) in c.columns:
                    ck = hit.select(F.col(kc(child)).alias("key"), F.col("__root").alias("root"))
                else:  # leaf table without its own key: match by the fk value
                    ck = hit.select(F.col(col).alias("key"), F.col("__root").alias("root"), F.lit(col).alias("__via"))
                new.setdefault(child, []).append(ck)
            else:
                raise ValueError(f"unknown on_delete {action}")
        frontier = {}
        for child, parts in new.items():
            found = functools.reduce(DataFrame.unionByName, parts).distinct()
            if child in reached:
                found = found.join(reached[child], found.columns, "left_anti")
            found = found.checkpoint()  # one level: read again by its own children, and by the tables at the end
            if found.isEmpty():
                continue
            reached[child] = reached[child].unionByName(found) if child in reached else found
            if kc(child) in tables[child].columns:
                frontier[child] = found
    if restricted:
        rej = restricted[0]
        for r in restricted[1:]:
            rej = rej.unionByName(r)
        rej = rej.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    else:
        rej = roots.select("root").limit(0).withColumn("reason", F.lit(None).cast("string"))
    bad = rej.select(F.col("root").alias("__bad"))
    out = dict(tables)
    for t, ks in reached.items():
        ok = ks.join(bad, ks["root"] == bad["__bad"], "left_anti")
        base = tables[t]
        if "__via" in ok.columns:  # keyless leaf: delete rows whose fk is in the set
            for via in [r for r in {col for ch, col, par, a in fks if ch == t}]:
                sub = ok.where(F.col("__via") == via).select(F.col("key").alias("__k")).distinct()
                base = base.join(sub, base[via] == sub["__k"], "left_anti")
            out[t] = base
        else:
            d = ok.select(F.col("key").alias("__k")).distinct()
            out[t] = out[t].join(d, out[t][kc(t)] == d["__k"], "left_anti")
    for t, items in nulled.items():
        cur = out[t]
        for col, ks in items:
            ok = ks.join(bad, ks["root"] == bad["__bad"], "left_anti").select(F.col("key").alias("__n")).distinct()
            cur = cur.join(ok, cur[col] == ok["__n"], "left")
            cur = cur.withColumn(col, F.when(F.col("__n").isNotNull(), F.lit(None).cast(cur.schema[col].dataType))
                                 .otherwise(F.col(col))).drop("__n")
        out[t] = cur
    out["__rejected"] = rej
    return out


# ---------------------------------------------------------------- M10 / M11
def normalize_order_status(col: str | Column) -> Column:
    """Accept the payload spelling ``canceled`` and store ``cancelled``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.lower(c) == "canceled", F.lit("cancelled")).otherwise(F.lower(c))


def order_status_change(orders: DataFrame, order_items: DataFrame, products: DataFrame, sellers: DataFrame,
                        changes: DataFrame, as_of=None, order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """``(order_id, seller_user_id, status, change_ts, seq)``.

    The user is resolved to their seller rows (D8); a change applies only if
    the order has a line of one of that seller's products (J6) and the
    status is valid. Returns {'orders', 'rejected'}."""
    ch = changes.withColumn("status", normalize_order_status("status"))
    sel = sellers.select(F.col("id").alias("__sid"), F.col("user_id").alias("__suser"))
    # Only the lines of orders named in the batch are read for the owner check.
    touched = ch.select(F.col("order_id").alias("__to")).distinct()
    lines = order_items.join(touched, order_items["order_id"] == touched["__to"], "left_semi")
    owners = (products.select(F.col("id").alias("__pid"), "seller_id").join(sel, F.col("seller_id") == F.col("__sid"))
              .select("__pid", "__suser"))
    pairs = (lines.select("order_id", "product_id").join(owners, F.col("product_id") == F.col("__pid"))
             .select(F.col("order_id").alias("__oid"), F.col("__suser").alias("__ou")))
    owned = pairs.distinct()
    flagged = ch.join(owned.withColumn("__owns", F.lit(True)),
                      (ch["order_id"] == owned["__oid"]) & (ch["seller_user_id"] == owned["__ou"]), "left")
    reason = (F.when(F.col("__owns").isNull(), F.lit("order not found or not owned"))
               .when(~F.col("status").isin(ENUMS["order_status"]), F.lit("invalid status")))
    flagged = flagged.withColumn("reason", reason)
    rejected = flagged.where(F.col("reason").isNotNull()).select(*ch.columns, "reason")
    # a semi join needs no distinct owners, and changes of an invalid status need no owner check; a null status keeps the old
    allowed = F.coalesce(F.col("status").isin(ENUMS["order_status"]), F.lit(True))
    valid = ch.where(allowed).join(pairs, (F.col("order_id") == F.col("__oid")) & (F.col("seller_user_id") == F.col("__ou")),
                                   "left_semi")
    new = patch_coalesce(orders, valid.select(F.col("order_id").alias("id"), "status", *order), "id", ["status"], as_of, order)
    return {"orders": new, "rejected": rejected}


def moderate_comments(comments: DataFrame, changes: DataFrame, as_of=None,
                      order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """``(comment_id, status, change_ts, seq)`` with status in the enum.

    Returns {'comments', 'touched_parents'}: the parents whose approved
    rating set may have changed (old and new status of each comment), for
    recomputing averages (M16), and 'rejected': changes of an unknown status
    or comment, with the reason."""
    known = comments.select(F.col("id").alias("__known"))
    judged = changes.join(known, changes["comment_id"] == F.col("__known"), "left").withColumn("reason", (
        F.when(~F.coalesce(F.col("status").isin(ENUMS["comment_status"]), F.lit(False)), F.lit("invalid status"))
         .when(F.col("__known").isNull(), F.lit("comment not found"))))
    rejected = judged.where(F.col("reason").isNotNull()).select(*changes.columns, "reason")
    valid = judged.where(F.col("reason").isNull()).select(*changes.columns)
    new = patch_coalesce(comments, valid.select(F.col("comment_id").alias("id"), "status", *order), "id",
                         ["status"], as_of, order)
    ids = valid.select(F.col("comment_id").alias("__c")).distinct()
    touched = comments.join(ids, comments["id"] == ids["__c"], "left_semi").select("parent_type", "parent_id").distinct()
    return {"comments": new, "touched_parents": touched, "rejected": rejected}


# ---------------------------------------------------------------- M14 / M18 / M6 tokens and codes
def purge_tokens(tokens: DataFrame, as_of) -> DataFrame:
    """Drop tokens that expired before ``as_of`` or are revoked."""
    t = F.lit(as_of).cast(tokens.schema["expires_at"].dataType)
    return tokens.where(~((F.col("expires_at") < t) | F.coalesce(F.col("is_revoked"), F.lit(False))))


def rotate_tokens(tokens: DataFrame, presented: DataFrame, as_of, life_days: int = 7,
                  order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """M6 (Q39): ``presented(token, change_ts, seq)``.

    In request order, a presented token that is live (not revoked,
    ``expires_at > as_of``) replaces *all* of its user's tokens with one new
    token valid for ``life_days``. So per user the earliest live presentation
    wins; a later presentation of that user finds its token deleted and is
    refused, as are unknown or dead tokens.
    Returns {'tokens', 'issued', 'rejected'}."""
    ts_type = tokens.schema["expires_at"].dataType
    now = F.lit(as_of).cast(ts_type)
    o = _order(order)
    live = tokens.where(~F.coalesce(F.col("is_revoked"), F.lit(False)) & (F.col("expires_at") > now))
    pres = presented.select(F.col("token").alias("__tok"), o.alias("__o"))
    hits = pres.join(live.select("token", "user_id"), pres["__tok"] == F.col("token"), "inner")
    per_user = hits.groupBy("user_id").agg(F.min_by("token", F.col("__o")).alias("__last"),
                                           F.min("__o").alias("__win"))
    winners = per_user.select(F.col("__win").alias("__wo"), F.col("__last").alias("__wt"))
    rejected = pres.join(winners, (F.col("__o") == F.col("__wo")) & (F.col("__tok") == F.col("__wt")),
                         "left_anti").select(F.col("__tok").alias("token"), F.col("__o.*"))
    issued = per_user.select(
        new_key(tokens.schema["id"].dataType, "refresh_token", "user_id", "__last").alias("id"),
        "user_id",
        F.sha2(F.concat_ws(":", F.lit("refresh"), F.col("user_id").cast("string"), F.col("__last"),
                           F.lit(str(as_of))), 256).alias("token"),
        (now + F.expr(f"INTERVAL {int(life_days)} DAYS")).cast(ts_type).alias("expires_at"),
        F.lit(False).alias("is_revoked"),
        now.alias("created_at"))
    kept = tokens.join(per_user.select(F.col("user_id").alias("__u")), tokens["user_id"] == F.col("__u"), "left_anti")
    return {"tokens": kept.unionByName(conform(issued, tokens)), "issued": conform(issued, tokens), "rejected": rejected}


def consume_codes(codes: DataFrame, users: DataFrame, submissions: DataFrame,
                  max_attempts: int = 5) -> dict[str, DataFrame]:
    """M18 (Q38): ``submissions(user_id, code, submitted_at)``.

    A submission matches a code of the same user with the same value that
    existed and was live at that moment (``expires_at > submitted_at``,
    attempts below the limit); among such codes the newest one (W1). In
    submission order the first successful submission verifies the user and
    deletes all of their codes, so later ones of that user find nothing.
    Returns {'users', 'codes', 'matched'}: matched holds, per verified user,
    the code consumed by the first successful submission."""
    s = submissions.select(F.col("user_id").alias("__u"), F.col("code").alias("__code"),
                           F.col("submitted_at").alias("__at"))
    cand = codes.join(s, (codes["user_id"] == s["__u"]) & (codes["verification_code"] == s["__code"]), "inner")
    cand = cand.where((F.col("expires_at") > F.col("__at")) & (F.col("created_at") <= F.col("__at"))
                      & (F.coalesce(F.col("attempts"), F.lit(0)) < max_attempts))
    row = F.struct(*[F.col(c) for c in codes.columns])
    per_submission = cand.groupBy("user_id", "__at", "__code").agg(
        F.max_by(row, F.struct("created_at", "id")).alias("__row"))
    matched = (per_submission.groupBy("user_id")
                             .agg(F.min_by("__row", F.struct("__at", "__code")).alias("__row"))
                             .select("__row.*"))
    who = matched.select(F.col("user_id").alias("__v"))
    new_users = users.join(who, users["id"] == who["__v"], "left")
    new_users = new_users.withColumn("is_verified", F.when(F.col("__v").isNotNull(), F.lit(True))
                                     .otherwise(F.col("is_verified"))).drop("__v")
    left = codes.join(who, codes["user_id"] == who["__v"], "left_anti")
    return {"users": new_users, "codes": left, "matched": matched}


# ---------------------------------------------------------------- M17
def promote_sellers(users: DataFrame, sellers: DataFrame, requests: DataFrame, as_of=None,
                    order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """M17 (Q14): ``(user_id, shop_name, change_ts, seq)``.

    Refused when the user is unknown, already a seller (before or by an
    earlier accepted request of the batch) or the shop name is taken (the
    same way). The batch result equals applying the requests one by one in
    (change_ts, seq) order (``serial.decide_claims``); equal orders are
    decided by a hash of the request and its landed number, missing ones
    come first.
    Accepted requests insert an active seller and set the user's role.
    Returns {'users', 'sellers', 'rejected'}.
    """
    u = users.select(F.col("id").alias("__uid")).distinct()
    s_user = sellers.select(F.col("user_id").alias("__su")).distinct()
    s_name = sellers.select(F.col("shop_name").alias("__sn")).distinct()
    r = (in_total_order(requests, order)
         .join(u, F.col("user_id") == F.col("__uid"), "left")
         .join(s_user, F.col("user_id") == F.col("__su"), "left")
         .join(s_name, F.col("shop_name") == F.col("__sn"), "left"))
    reason = (F.when(F.col("__uid").isNull(), F.lit("user not found"))
               .when(F.col("shop_name").isNull(), F.lit("shop name is missing"))
               .when(F.col("__su").isNotNull(), F.lit("user is already a seller"))
               .when(F.col("__sn").isNotNull(), F.lit("shop name is already taken")))
    r = r.withColumn("reason", reason).select(*requests.columns, TOTAL, "reason").checkpoint()
    judged = decide_claims(r.where(F.col("reason").isNull()).drop("reason"), ["user_id", "shop_name"])
    lost = F.when(F.array_contains("__failed", 0), F.lit("user is already a seller")).otherwise(
        F.lit("shop name is already taken"))
    rejected = r.where(F.col("reason").isNotNull()).select(*requests.columns, "reason").unionByName(
        judged.where(~accepted()).select(*requests.columns, lost.alias("reason")))
    ok = judged.where(accepted()).select(*requests.columns)
    new_sellers = ok.select(new_key(sellers.schema["id"].dataType, "seller", "user_id").alias("id"), "user_id",
                            "shop_name", F.lit("active").alias("status"))
    all_sellers, _ = insert(sellers, new_sellers, "sellers", as_of)
    promoted = ok.select(F.col("user_id").alias("__p")).distinct()
    nu = users.join(promoted, users["id"] == promoted["__p"], "left")
    nu = nu.withColumn("role", F.when(F.col("__p").isNotNull(), F.lit("seller")).otherwise(F.col("role")))
    nu = touch(nu, F.col("__p").isNotNull(), as_of).drop("__p")
    return {"users": nu, "sellers": all_sellers, "rejected": rejected}


# ---------------------------------------------------------------- Q36 several unique columns inside a batch
def first_of_batch(requests: DataFrame, unique_cols: Sequence[str], order_col: str) -> dict[str, DataFrame]:
    """Requests that one-by-one application in the order of ``order_col`` would accept when every column of
    ``unique_cols`` must differ from all earlier accepted requests (nulls never clash, ``serial.decide_claims``). Equal
    orders are decided by a hash of the request and its landed number, missing ones come first: every request is
    accepted or rejected, never both. Returns {'accepted', 'rejected'}.
    """
    judged = decide_claims(in_total_order(requests, [order_col]), list(unique_cols))
    return {"accepted": judged.where(accepted()).select(*requests.columns),
            "rejected": judged.where(~accepted()).select(*requests.columns)}


# ---------------------------------------------------------------- Q11 / Q24 renames and creates with unique names
def rename_unique(base: DataFrame, changes: DataFrame, key: str, name_cols: Sequence[str], as_of=None,
                  order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Q11 / Q24 update: rename rows while the name (tuple) stays unique.

    Serial meaning: in (change_ts, seq) order a change sets the name
    (null fields keep their value, M2) unless another row holds the new name
    at that moment; a name is freed when its holder is renamed
    (``serial.decide_patches``). Equal orders are decided by a hash of the
    change and its landed number, missing ones come first.
    Returns {'base', 'rejected'}.
    """
    names = list(name_cols)
    judged = decide_patches(base, in_total_order(changes, order), key, [names])
    # a change for a row that does not exist updates nothing (the source answers "not found")
    reason = F.when(~F.col("__known"), F.lit("not found")).otherwise(F.lit("name already in use"))
    rejected = judged.where(~F.col("__known") | ~accepted()).select(*changes.columns, reason.alias("reason"))
    out = patch_coalesce(base, judged.where(F.col("__known") & accepted()), key, names, as_of, (TOTAL,))
    return {"base": out.select(*base.columns), "rejected": rejected}


def create_unique(base: DataFrame, new_rows: DataFrame, table: str, name_cols: Sequence[str],
                  key_namespace: str, as_of=None, order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Q24 create (M1 + C1): insert rows whose name tuple is not taken (first
    of the batch wins, equal orders by a hash of the row and its landed number; a missing name part is
    refused). Keys are derived from the name tuple."""
    columns, names = new_rows.columns, list(name_cols)
    new_rows = in_total_order(new_rows, order)
    nameless = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    missing = new_rows.where(nameless).select(*columns, F.lit("name is missing").alias("reason"))
    new_rows = new_rows.where(~nameless)
    taken = base.select(*names).distinct()
    fresh = new_rows.join(taken, names, "left_anti")
    clash = new_rows.join(taken, names, "left_semi").select(*columns, F.lit("name already in use").alias("reason"))
    first = fresh.groupBy(*names).agg(F.min(TOTAL).alias("__first"))
    fresh = fresh.join(first, names)
    dup = fresh.where(F.col(TOTAL) != F.col("__first")).select(*columns, F.lit("name already in use").alias("reason"))
    ok = fresh.where(F.col(TOTAL) == F.col("__first")).select(*columns)
    ok = ok.withColumn("id", new_key(base.schema["id"].dataType, key_namespace, *names))
    all_rows, inserted = insert(base, ok, table, as_of)
    return {"base": all_rows, "inserted": inserted, "rejected": clash.unionByName(dup).unionByName(missing)}


# ---------------------------------------------------------------- Q30 comment create
def create_comments(comments: DataFrame, new: DataFrame, parents: dict[str, DataFrame], users: DataFrame, as_of=None,
                    key_namespace: str = "comment") -> dict[str, DataFrame]:
    """New comments ``(user_id, parent_type, parent_id, content, rating, change_ts, seq)``.

    Refused when the parent of the named type does not exist (the source's
    trigger, J8), the rating is outside 1..5 or the content is not 2..1000
    characters. Accepted ones are inserted as pending, those of an admin as
    approved. Returns
    {'comments', 'inserted', 'rejected'}."""
    found = None
    for ptype, table in sorted(parents.items()):
        keys = table.select(F.col("id").alias("__pid")).withColumn("__ptype", F.lit(ptype))
        found = keys if found is None else found.unionByName(keys)
    j = new.join(found, (new["parent_type"] == F.col("__ptype")) & (new["parent_id"] == F.col("__pid")), "left")
    n = F.length("content")
    reason = (F.when(~F.col("parent_type").isin(ENUMS["comment_parent_type"]), F.lit("invalid parent type"))
               .when(F.col("__pid").isNull(), F.lit("parent not found"))
               .when(F.col("rating").isNull() | (F.col("rating") < 1) | (F.col("rating") > 5), F.lit("invalid rating"))
               .when(F.col("content").isNull() | (n < 2) | (n > 1000), F.lit("invalid content")))
    j = j.withColumn("reason", reason)
    rejected = j.where(F.col("reason").isNotNull()).select(*new.columns, "reason")
    ok = j.where(F.col("reason").isNull()).select(*new.columns)
    ok = ok.withColumn("id", new_key(comments.schema["id"].dataType, key_namespace, "user_id", *request_key()))
    admins = users.where(F.col("role") == "admin").select(F.col("id").alias("__admin")).distinct()
    ok = ok.join(admins, ok["user_id"] == F.col("__admin"), "left")
    ok = ok.withColumn("status", F.when(F.col("__admin").isNotNull(), F.lit("approved")).otherwise(F.lit("pending")))
    ok = ok.drop("__admin").withColumn("created_at", F.col("change_ts"))
    all_rows, inserted = insert(comments, ok, "comments", as_of)
    return {"comments": all_rows, "inserted": inserted, "rejected": rejected}


# ---------------------------------------------------------------- Q34 address create (M1 + W5 = M13)
def create_addresses(addresses: DataFrame, new: DataFrame, as_of=None, key_namespace: str = "address",
                     order: Sequence[str] = ORDER) -> DataFrame:
    """New addresses ``(user_id, address, city, province, postal_code, is_default,
    change_ts, seq)``: inserted (default flag false when absent); a new
    default clears the user's other defaults, the last one of the batch
    winning (M13)."""
    from .windows import apply_exclusive_flag
    rows = new.withColumn("id", new_key(addresses.schema["id"].dataType, key_namespace, "user_id", *request_key(*order)))
    all_rows, inserted = insert(addresses, rows.withColumn("created_at", F.col(order[0])), "addresses", as_of)
    req = rows.where(F.coalesce(F.col("is_default"), F.lit(False))).select("user_id", "id", *order)
    return apply_exclusive_flag(all_rows, req, as_of=as_of)


# ---------------------------------------------------------------- Q21 cart line removal (M7)
def remove_cart_items(carts: DataFrame, cart_items: DataFrame, requests: DataFrame,
                      as_of=None) -> dict[str, DataFrame]:
    """``requests(user_id, cart_id, product_id)``: remove the line only when the
    cart belongs to the requesting user; touch that cart (M15).
    Returns {'cart_items', 'carts', 'rejected'}."""
    own = carts.select(F.col("id").alias("__c"), F.col("user_id").alias("__u"))
    lines = cart_items.select(F.col("cart_id").alias("__lc"), F.col("product_id").alias("__lp"))
    r = (requests.join(own, (requests["cart_id"] == F.col("__c")) & (requests["user_id"] == F.col("__u")), "left")
                 .join(lines, (F.col("cart_id") == F.col("__lc")) & (F.col("product_id") == F.col("__lp")), "left"))
    ok = F.col("__c").isNotNull() & F.col("__lc").isNotNull()
    rejected = r.where(~ok).select(*requests.columns)
    dels = r.where(ok).select("cart_id", "product_id").distinct()
    items = cart_items.join(dels, ["cart_id", "product_id"], "left_anti")
    touched = dels.select(F.col("cart_id").alias("__t")).distinct()
    c = carts.join(touched, carts["id"] == touched["__t"], "left")
    c = touch(c, F.col("__t").isNotNull(), as_of).drop("__t")
    return {"cart_items": items, "carts": c, "rejected": rejected}


# ---------------------------------------------------------------- Q27 blog create
def create_blogs(blogs: DataFrame, new: DataFrame, as_of=None, key_namespace: str = "blog") -> dict[str, DataFrame]:
    """``new(author_id, title, content, change_ts, seq)`` (``en_title`` optional):
    insert with ``en_title`` defaulting to the title (D6) and views 0; titles
    must be 3..255 characters. Returns {'blogs', 'inserted', 'rejected'}."""
    n = F.length("title")
    bad = F.col("title").isNull() | (n < 3) | (n > 255) | F.col("content").isNull()
    rejected = new.where(bad).withColumn("reason", F.lit("invalid title or content"))
    ok = new.where(~bad)
    en = F.coalesce(F.col("en_title"), F.col("title")) if "en_title" in new.columns else F.col("title")
    ok = ok.select(new_key(blogs.schema["id"].dataType, key_namespace, "author_id", *request_key()).alias("id"),
                   "author_id", "title", en.alias("en_title"), "content", F.lit(None).cast("int").alias("views"),
                   F.col("change_ts").alias("created_at"))
    inserted = with_defaults(ok, "blogs", as_of)
    return {"blogs": blogs.unionByName(conform(inserted, blogs)), "inserted": inserted, "rejected": rejected}


def update_addresses(addresses: DataFrame, changes: DataFrame, fields: Sequence[str], as_of=None,
                     order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Q34 update: ``(id, user_id, <fields>, is_default, change_ts, seq)``.

    Only the owner's own address is changed (others are refused, as the
    source's ``WHERE id = $6 AND user_id = $7``); fields follow M2 (null
    keeps); a change with ``is_default = true`` makes that address the
    user's only default (W5). In serial order that means: the user's last
    ``true`` change decides the default address (all others false) unless a
    later ``false`` change targets that same address; users without a
    ``true`` change just get their ``false`` changes applied.
    Returns {'addresses', 'rejected'}."""
    own = addresses.select(F.col("id").alias("__a"), F.col("user_id").alias("__u"))
    j = changes.join(own, (changes["id"] == F.col("__a")) & (changes["user_id"] == F.col("__u")), "left")
    rejected = j.where(F.col("__a").isNull()).select(*changes.columns).withColumn("reason", F.lit("address not found"))
    ok = j.where(F.col("__a").isNotNull()).select(*changes.columns)
    patched = patch_coalesce(addresses, ok, "id", [*fields, "is_default"], as_of, order)
    o = _order(order)
    last_true = (ok.where(F.col("is_default") == F.lit(True))
                   .groupBy(F.col("user_id").alias("__tu"))
                   .agg(F.max_by(F.col("id"), o).alias("__tid"), F.max(o).alias("__to")))
    later_false = (ok.where(F.col("is_default") == F.lit(False))
                     .join(last_true, (F.col("user_id") == F.col("__tu")) & (F.col("id") == F.col("__tid")))
                     .where(o > F.col("__to")).select(F.col("user_id").alias("__ku")).distinct())
    out = (patched.join(last_true, patched["user_id"] == F.col("__tu"), "left")
                  .join(later_false, F.col("user_id") == F.col("__ku"), "left"))
    out = out.withColumn("is_default", F.when(F.col("__tu").isNotNull(),
                                              (F.col("id") == F.col("__tid")) & F.col("__ku").isNull())
                         .otherwise(F.col("is_default")))
    return {"addresses": out.drop("__tu", "__tid", "__to", "__ku"), "rejected": rejected}


def parse_once(df: DataFrame, json_col: str, schema: T.StructType, as_: str) -> DataFrame:
    """``df`` with its JSON column parsed into the struct ``as_``, row by row once. A filter over a plain projection
    would be moved below it and parse the text again for every rule that reads a field; it stays above an explode."""
    return df.select("*", F.explode(F.array(F.from_json(F.col(json_col), schema))).alias(as_))


# ---------------------------------------------------------------- Q5 product create (S3 + M1 + C10)
PRODUCT_DOC_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("stock", T.IntegerType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("features", T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                                        T.StructField("value", T.StringType())]))),
])


def create_products(documents: DataFrame, doc_id: str = "doc_id", seller_col: str = "seller_id",
                    json_col: str = "document", as_of=None, key_type: T.DataType = T.LongType()) -> dict[str, DataFrame]:
    """Q5: product documents -> products (defaults applied: stock 0, status
    active), bridge rows and feature rows, in one unit; invalid documents
    (C10: name, price > 0, at least one category, stock >= 0, features with name and value) are reported.
    Returns {'products', 'product_categories', 'product_features', 'violations'}."""
    from .audit import array_size_rule, items_rule, range_rule, required_rule, validate
    parsed = parse_once(documents, json_col, PRODUCT_DOC_SCHEMA, "__d").select(doc_id, seller_col, "__d.*")
    rules = [required_rule("name"), required_rule("price"), range_rule("price", 0, None, low_exclusive=True),
             required_rule("categories"), array_size_rule("categories", 1, None), range_rule("stock", 0, None),
             items_rule("features", "feature", lambda x: x["name"].isNull() | x["value"].isNull())]
    valid, violations = validate(parsed, rules, doc_id, "product_documents")
    valid = valid.withColumn("id", new_key(key_type, "product", doc_id))
    products = with_defaults(valid.select("id", F.col(seller_col).alias("seller_id"), "name", "price",
                                          "description", "stock", F.lit(None).cast("string").alias("status")),
                             "products", as_of)
    bridge = valid.select(F.col("id").alias("product_id"), F.explode("categories").alias("category_id"))
    feats = valid.select(F.col("id").alias("product_id"), F.explode_outer("features").alias("__f")).where(
        F.col("__f").isNotNull()).select("product_id", "__f.name", "__f.value")
    return {"products": products, "product_categories": bridge, "product_features": feats,
            "violations": violations}


# ---------------------------------------------------------------- S3 / M21
ORDER_DOC_SCHEMA = T.StructType([
    T.StructField("address_id", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("product_id", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.DecimalType(12, 2))]))),
])


def shred(df: DataFrame, json_col: str, schema: T.StructType, array_field: str, key: str,
          position: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """S3: parse a JSON document column and split it into a header frame and a
    child-line frame (one row per array element, with its 1-based position)."""
    parsed = parse_once(df, json_col, schema, "__doc")
    header_fields = [f.name for f in schema.fields if f.name != array_field]
    header = parsed.select(F.col(key), *[F.col(f"__doc.{f}").alias(f) for f in header_fields])
    return header, lines_of(parsed, "__doc", array_field, key, position)


def lines_of(parsed: DataFrame, struct_col: str, array_field: str, key: str, position: str = "line_no") -> DataFrame:
    """One row per element of a parsed document's array, with its 1-based position."""
    return (parsed.select(F.col(key), F.posexplode(F.col(f"{struct_col}.{array_field}")).alias("__pos", "__item"))
                  .select(F.col(key), (F.col("__pos") + 1).cast("bigint").alias(position), F.col("__item.*")))


def place_orders(documents: DataFrame, user_col: str = "user_id", doc_id: str = "doc_id",
                 json_col: str = "document", as_of=None, parsed_col: str | None = None) -> dict[str, DataFrame]:
    """M21 (Q16): order documents -> order headers and lines in one unit.

    Header total is the sum of ``quantity * price`` of its lines (D3),
    status starts as pending; ``payment_method`` is kept. Order ids are
    derived from the document id, so a re-run yields the same keys.
    Documents that were parsed before, to be checked, come with the struct
    ``parsed_col`` (of ``ORDER_DOC_SCHEMA``) and are not parsed again.
    Returns {'orders', 'order_items'}."""
    if parsed_col:
        headers = documents.withColumn("__d", F.col(parsed_col))
        lines = lines_of(documents, parsed_col, "items", doc_id)
    else:
        headers = documents.withColumn("__d", F.from_json(F.col(json_col), ORDER_DOC_SCHEMA))
        _, lines = shred(documents.select(doc_id, json_col), json_col, ORDER_DOC_SCHEMA, "items", doc_id)
    zero = F.lit(0).cast("decimal(38,2)")
    total = F.aggregate("__d.items", zero, lambda a, x: (a + F.coalesce(
        x["quantity"].cast("bigint") * x["price"], zero)).cast("decimal(38,2)"))
    orders = headers.select(new_key(T.LongType(), "order", doc_id).alias("id"), user_col, F.col("__d.address_id"),
                            F.coalesce(total, zero).cast("decimal(12,2)").alias("total_amount"),
                            F.lit("pending").alias("status"), F.col("__d.payment_method"), F.col(doc_id))
    items = lines.select(new_key(T.LongType(), "order", doc_id).alias("order_id"), "line_no", "product_id",
                         "quantity", F.col("price").alias("price_at_time"), F.col(doc_id))
    if as_of is not None:
        orders = orders.withColumn("created_at", F.lit(as_of).cast("timestamp"))
    return {"orders": orders, "order_items": items}
