"""Nested child collections and one-row lookups.

Children are grouped by their foreign key with a partial aggregate and
left-joined to the parents: one shuffle of the child table, no correlated
subquery. For listings, apply these to a page of parents (see
``paging.restrict_to_keys``) so only the page's children are aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dealing import deal


def _fields(fields: Sequence[str | Column | tuple[str, str]]) -> list[Column]:
    out = []
    for f in fields:
        if isinstance(f, tuple):  # (source column, output name)
            out.append(F.col(f[0]).alias(f[1]))
        elif isinstance(f, str):
            out.append(F.col(f))
        else:
            out.append(f)
    return out


def collect_children(child: DataFrame, fk: str, fields, as_: str, key_name: str = "__fk") -> DataFrame:
    """(fk, sorted array of child structs). Array order = struct order (first field first)."""
    return (child.where(F.col(fk).isNotNull())
                 .groupBy(F.col(fk).alias(key_name))
                 .agg(F.sort_array(F.collect_list(F.struct(*_fields(fields)))).alias(as_)))


def nest(parent: DataFrame, child: DataFrame, on: tuple[str, str], fields, as_: str,
         empty: str = "null") -> DataFrame:
    """Attach each parent's children as an array of structs.

    ``on = (parent key, child foreign key)``. ``empty='null'`` gives null for a
    childless parent (A7, like ``json_agg`` over no rows); ``empty='array'``
    gives an empty array (A8, like ``COALESCE(array_agg(..), ARRAY[])``).
    """
    pkey, fk = on
    grouped = collect_children(child, fk, fields, as_)
    out = parent.join(grouped, parent[pkey] == grouped["__fk"], "left").drop("__fk")
    if empty == "array":
        elem = grouped.schema[as_].dataType
        out = out.withColumn(as_, F.coalesce(F.col(as_), F.array().cast(elem)))
    elif empty != "null":
        raise ValueError("empty must be 'null' or 'array'")
    return out


def nest_many(parent: DataFrame, pkey: str, specs, empty: str = "null", tasks: int = 0) -> DataFrame:
    """Several child collections of one parent in a single aggregation.

    ``specs`` is a list of (child, fk, fields, as_). The children are
    projected to (fk, one struct column per collection, the others null),
    unioned and grouped once by the foreign key, so k collections cost one
    shuffle and one join instead of k. ``collect_list`` skips the nulls;
    with ``empty='null'`` an empty collection becomes null (A7), with
    ``'array'`` it stays ``[]`` (A8). ``tasks`` deals parents and children to so
    many tasks by the key, which bounds the arrays that one task holds.
    """
    typed = []
    for child, fk, fields, as_ in specs:
        s = F.struct(*_fields(fields))
        typed.append((child, fk, s, as_, child.select(s.alias("__s")).schema["__s"].dataType))
    parts = []
    for i, (child, fk, s, as_, _) in enumerate(typed):
        cols = [F.col(fk).alias("__fk")]
        for j, (_, _, s2, as2, dtype) in enumerate(typed):
            cols.append(s.alias(as2) if i == j else F.lit(None).cast(dtype).alias(as2))
        parts.append(child.where(F.col(fk).isNotNull()).select(*cols))
    unioned = parts[0]
    for p in parts[1:]:
        unioned = unioned.unionByName(p)
    aggs = []
    for _, _, _, as_, _ in typed:
        c = F.sort_array(F.collect_list(F.col(as_)))
        aggs.append((F.when(F.size(c) == 0, F.lit(None)).otherwise(c) if empty == "null" else c).alias(as_))
    parent, grouped = deal(parent, tasks, pkey), deal(unioned, tasks, "__fk").groupBy("__fk").agg(*aggs)
    out = parent.join(grouped, parent[pkey] == grouped["__fk"], "left").drop("__fk")
    if empty == "array":
        for _, _, _, as_, dtype in typed:
            out = out.withColumn(as_, F.coalesce(F.col(as_), F.array().cast(T.ArrayType(dtype))))
    return out


def nest_through(parent: DataFrame, bridge: DataFrame, target: DataFrame,
                 on: tuple[str, str, str, str], fields, as_: str, empty: str = "null") -> DataFrame:
    """Many-to-many nesting (J13 + A7): parent -bridge- target.

    ``on = (parent key, bridge parent fk, bridge target fk, target key)``.
    """
    pkey, b_parent, b_target, tkey = on
    linked = bridge.join(target, bridge[b_target] == target[tkey], "inner")
    return nest(parent, linked, (pkey, b_parent), fields, as_, empty)


def scalar_list(parent: DataFrame, child: DataFrame, on: tuple[str, str], value: str, as_: str,
                empty: str = "null") -> DataFrame:
    """Nested list of one scalar (A9), sorted."""
    pkey, fk = on
    grouped = (child.where(F.col(fk).isNotNull())
                    .groupBy(F.col(fk).alias("__fk"))
                    .agg(F.sort_array(F.collect_list(F.col(value))).alias(as_)))
    out = parent.join(grouped, parent[pkey] == grouped["__fk"], "left").drop("__fk")
    if empty == "array":
        out = out.withColumn(as_, F.coalesce(F.col(as_), F.array().cast(T.ArrayType(child.schema[value].dataType))))
    return out


def one_per_key(df: DataFrame, key: str, pick_by: str | Sequence[str], fields, as_: str,
                smallest: bool = True) -> DataFrame:
    """(key, struct) keeping the row with the smallest (or largest) ``pick_by``.

    ``min_by`` is a partial aggregate: hot keys are reduced map-side.
    Used for J10 (a user's seller row when several exist) and J11 (main image).
    """
    picks = [pick_by] if isinstance(pick_by, str) else list(pick_by)
    order = F.struct(*[F.col(p) for p in picks])
    agg = F.min_by if smallest else F.max_by
    return df.groupBy(F.col(key).alias("__k")).agg(agg(F.struct(*_fields(fields)), order).alias(as_))


def attach_one(parent: DataFrame, one: DataFrame, pkey: str) -> DataFrame:
    """Left-join a one-row-per-key struct frame from ``one_per_key``."""
    return parent.join(one, parent[pkey] == one["__k"], "left").drop("__k")


def polymorphic_parent(df: DataFrame, type_col: str, id_col: str,
                       targets: dict[str, tuple[DataFrame, str, dict[str, str]]], as_: str) -> DataFrame:
    """One struct describing a row's parent, whose table depends on a type column.

    ``targets`` maps type value -> (table, key column, {output field: source column}).
    Each target is left-joined with a join condition that includes the type
    guard, so a product id never matches a blog row. The output struct has
    the union of all fields; fields of other types are null, and the whole
    struct is null when the parent is missing.
    """
    all_fields = sorted({f for _, _, m in targets.values() for f in m})
    out = df
    found = []
    for i, (tval, (table, key, mapping)) in enumerate(sorted(targets.items())):
        alias = f"__p{i}"
        cols = [F.col(key).alias(f"{alias}_key")] + [F.col(src).alias(f"{alias}_{dst}") for dst, src in mapping.items()]
        side = table.select(*cols)
        cond = (out[type_col] == F.lit(tval)) & (out[id_col] == side[f"{alias}_key"])
        out = out.join(side, cond, "left")
        found.append((tval, alias, mapping))
    struct_fields = [F.col(id_col).alias("id")]
    for f in all_fields:
        expr = F.lit(None)
        for tval, alias, mapping in found:
            if f in mapping:
                expr = F.when(F.col(type_col) == tval, F.col(f"{alias}_{f}")).otherwise(expr)
        struct_fields.append(expr.alias(f))
    present = F.lit(False)
    for tval, alias, _ in found:
        present = present | ((F.col(type_col) == tval) & F.col(f"{alias}_key").isNotNull())
    out = out.withColumn(as_, F.when(present, F.struct(*struct_fields)))
    drop = [c for c in out.columns if c.startswith("__p")]
    return out.drop(*drop)
