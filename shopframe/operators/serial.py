"""Batches that must equal serial application although requests conflict over unique values (Q11, Q14, Q24, Q32, Q36).

Whether a request is accepted depends on who holds a value at that moment, so on all earlier requests that touched it.
Only few requests are entangled in that way. The plan finds them and replays nothing else:

* every request gets a place in one total order: its order columns, then a hash of all its columns, then a number that
  is landed once; nulls come first, so equal and missing orders are decided alike in every run;
* a value that a row outside the batch holds, or the first claimant of a value is sure to get, is refused to all others
  by a join; a value that only one row touches conflicts with nothing;
* what is left is a graph of rows and contested values. Requests of different components never affect each other.
  Components are found from at most ``LOCAL_EDGES`` links in one task, and by alternating star steps beyond;
* each component is replayed in order as a sorted stream. A task keeps the values held in the component it is in.

The number of jobs does not depend on how long a chain of requests is, nor on how often one row changes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LOCAL_EDGES = 1_000_000
ORDER = "__o"


def in_total_order(requests: DataFrame, order: Sequence[str]) -> DataFrame:
    """``requests`` with __o, a struct that no two rows share: ``order``, a hash of all columns and a landed number."""
    ensure_checkpoint_dir(requests.sparkSession)
    place = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in requests.columns]).alias("__hash"),
                     F.monotonically_increasing_id().alias("__number"))
    return requests.withColumn(ORDER, place).checkpoint()


def _union_find():
    """Components of a bounded list of links in one task (a function of its own, so that workers need no copy of this
    package)."""
    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for pdf in frames:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at:at + 100_000]
            yield pd.DataFrame({"node": part, "class": [root(x) for x in part]}, dtype="int64")
    return joined


def classes(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, class) of every node of ``edges(a, b)``, two longs; class is the smallest node of the component.

    Up to ``local_edges`` links (16 bytes each) go through one task. More are contracted by alternating steps that hang
    a node's larger, then its smaller neighbours below the smallest one, each a minimum for every node (combined before
    the shuffle) and a join, checkpointed, until nothing changes.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    if now.count() <= local_edges:
        return now.coalesce(1).mapInPandas(_union_find(), "node long, class long")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        now = (large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
               .where("a <> b").select("a", "b").distinct().checkpoint())
        after = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("class")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct())


def replayer(unique: list[list[int]]):
    """A function over frames of (class, late, id, row, wanted, probe), sorted by class, late and order, that yields (id, failed): the numbers of the
    constraints (lists of places in ``wanted``) that keep a request from being accepted at its moment. Rows with late 0
    say what a row holds at first; ``probe`` asks for one constraint of a request that is refused already."""
    def replay(frames):
        now, held, rows = None, {}, {}

        def value(parts, constraint):
            found = tuple(parts[c] for c in constraint)
            return None if None in found else found

        for pdf in frames:
            out = []
            for cls, late, number, row, wanted, probe in zip(pdf["class"].tolist(), pdf["late"].tolist(),
                                                            pdf["id"].tolist(), pdf["row"].tolist(),
                                                            pdf["wanted"].tolist(), pdf["probe"].tolist()):
                if cls != now:
                    now, held, rows = cls, {}, {}
                wanted = [None if w is None else str(w) for w in wanted]
                current = rows.get(row)
                if not late:
                    rows[row] = wanted
                    for i, constraint in enumerate(unique):
                        v = value(wanted, constraint)
                        if v is not None:
                            held.setdefault((i, v), set()).add(row)
                    continue
                target = wanted if current is None else [c if w is None else w for w, c in zip(wanted, current)]
                asked = [i for i, constraint in enumerate(unique) if any(wanted[c] is not None for c in constraint)]
                if probe >= 0:
                    asked = [probe]
                failed = [i for i in asked if (v := value(target, unique[i])) is not None and
                          held.get((i, v), set()) - {row}]
                out.append((number, failed))
                if failed or probe >= 0:
                    continue
                for i in asked:
                    if current is not None and (v := value(current, unique[i])) is not None:
                        held[(i, v)].discard(row)
                        if not held[(i, v)]:
                            del held[(i, v)]
                    if (v := value(target, unique[i])) is not None:
                        held.setdefault((i, v), set()).add(row)
                rows[row] = target
            yield pd.DataFrame(out, columns=["id", "failed"])
    return replay


def _tokens(values: Column, unique: list[list[int]], shown: list[int]) -> Column:
    """(i, v) of the values by which constraint i can meet another row: the value of its column ``shown[i]``."""
    found = F.array(*[F.struct(F.lit(i).alias("i"), values[shown[i]].alias("v")) for i in range(len(unique))])
    return F.filter(found, lambda t: t["v"].isNotNull())


def _row_node(row) -> Column:
    return F.xxhash64(F.lit("row"), row)


def _value_node(i, v) -> Column:
    return F.xxhash64(F.lit("value"), i, v)


def replayed(live: DataFrame, held: DataFrame, probes: DataFrame, unique: list[list[int]], shown: list[int],
             local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, failed) of the requests that depend on others; a request that is missing is free of conflicts.

    ``live(id, o, row, wanted)`` and ``probes(id, o, row, wanted, probe)`` are requests, ``held(row, wanted)`` what rows
    hold at first. Nodes are hashes: two that fall together only merge two components.
    """
    t = F.explode(_tokens(F.col("wanted"), unique, shown)).alias("t")
    linked = live.select("row", t).unionByName(held.select("row", t)).select("row", "t.i", "t.v")
    probed = F.get("wanted", F.get(F.array(*[F.lit(s) for s in shown]), F.col("probe")))
    asked = probes.select("row", F.col("probe").alias("i"), probed.alias("v"))
    contested = (linked.unionByName(asked).groupBy("i", "v").agg(F.min("row").alias("low"), F.max("row").alias("high"))
                 .where("low <> high").select("i", "v"))
    edges = linked.join(contested, ["i", "v"]).select(_row_node(F.col("row")).alias("a"),
                                                      _value_node(F.col("i"), F.col("v")).alias("b"))
    of = classes(edges, local_edges).checkpoint()
    none = F.lit(None).cast(live.schema["o"].dataType)
    events = (held.select(_row_node(F.col("row")).alias("node"), F.lit(0).alias("late"), none.alias("o"),
                          F.lit(-1).cast("long").alias("id"), "row", "wanted", F.lit(-1).alias("probe"))
              .unionByName(live.select(_row_node(F.col("row")).alias("node"), F.lit(1).alias("late"), "o", "id", "row",
                                       "wanted", F.lit(-1).alias("probe")))
              .unionByName(probes.select(
                  _value_node(F.col("probe"), probed).alias("node"), F.lit(1).alias("late"), "o", "id", "row", "wanted",
                  "probe")))
    sorted_events = (events.join(of, "node").repartition("class").sortWithinPartitions("class", "late", "o")
                     .select("class", "late", "id", "row", "wanted", "probe"))
    return (sorted_events.mapInPandas(replayer(unique), "id long, failed array<int>")
            .groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("failed"))).alias("failed")))


def _texts(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in cols])


def _judged(requests: DataFrame, static: DataFrame | None, found: DataFrame) -> DataFrame:
    """``requests`` with __failed, from what is refused by a join (id, static) and what the replay says (id, failed)."""
    out = requests.withColumn("__id", F.col(ORDER)["__number"])
    none = F.array().cast("array<int>")
    if static is not None:
        out = out.join(static.select(F.col("id").alias("__id"), "static"), "__id", "left")
    else:
        out = out.withColumn("static", none)
    out = out.join(found.select(F.col("id").alias("__id"), "failed"), "__id", "left")
    failed = F.array_sort(F.array_union(F.coalesce("static", none), F.coalesce("failed", none)))
    return out.withColumn("__failed", failed).drop("__id", "static", "failed")


def _with_static(requests: DataFrame, taken: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests that want none of the ``taken(i, v)`` values, the other ones as probes of their remaining values, and
    (id, static) of these."""
    one = [[c] for c in range(n)]
    hit = (requests.select("id", F.explode(_tokens(F.col("wanted"), one, list(range(n)))).alias("t"))
           .select("id", "t.i", "t.v").join(taken, ["i", "v"]).groupBy("id").agg(F.collect_set("i").alias("static")))
    hit = hit.checkpoint()
    marked = requests.join(hit, "id", "left")
    live = marked.where(F.col("static").isNull()).drop("static")
    rest = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ~F.array_contains("static", i) &
                    F.get("wanted", i).isNotNull())
    probes = marked.where(F.col("static").isNotNull()).select("id", "o", "row", "wanted", F.explode(rest).alias("probe"))
    return live, probes, hit


def decide_patches(base: DataFrame, requests: DataFrame, key: str, unique: Sequence[Sequence[str]],
                   local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``requests`` (in total order, see ``in_total_order``) with __known, whether ``base`` has the row, and __failed,
    the numbers of the constraints whose new value another row holds at that moment.

    A request sets the columns of ``unique`` that it names (null keeps a value) when nothing fails. Each constraint is
    a list of columns whose values together must be unique; one with a null part never clashes.
    """
    cols = list(dict.fromkeys(c for constraint in unique for c in constraint))
    places = [[cols.index(c) for c in constraint] for constraint in unique]
    exact = all(len(p) == 1 for p in places)
    row = F.col(key).cast("string").alias("row")
    asked = requests.select(F.col(ORDER)["__number"].alias("id"), F.col(ORDER).alias("o"), row, _texts(cols).alias("wanted"))
    touched = asked.select("row").where("row is not null").distinct()
    everyone = base.select(row, _texts(cols).alias("wanted")).where("row is not null")
    mine = everyone.join(touched, "row", "left_semi").checkpoint()
    known = mine.select("row").distinct().withColumn("__known", F.lit(True))
    live = asked.join(known.select("row"), "row", "left_semi")
    shown = [p[0] for p in places]
    if not exact:  # requests may name part of a value: rows are linked by the column with the most different values
        counts = live.agg(*[F.approx_count_distinct(F.get("wanted", F.lit(c))).alias(f"c{c}") for c in range(len(cols))]).first()
        shown = [max(p, key=lambda c: counts[f"c{c}"]) for p in places]

    def values(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(_tokens(F.col("wanted"), places, shown)).alias("t")).select("t.i", "t.v").distinct()

    wanted = values(live if exact else live.select("wanted").unionByName(mine.select("wanted")))
    others = (everyone.join(touched, "row", "left_anti")
              .select("row", "wanted", F.explode(_tokens(F.col("wanted"), places, shown)).alias("t"))
              .select("row", "wanted", "t.i", "t.v").join(wanted, ["i", "v"], "left_semi"))
    if exact:
        live, probes, static = _with_static(live, others.select("i", "v").distinct(), len(cols))
        held = mine
    else:
        held = mine.unionByName(others.select("row", "wanted").distinct())
        probes, static = live.limit(0).withColumn("probe", F.lit(-1)), None
    found = replayed(live, held, probes, places, shown, local_edges)
    out = _judged(requests, static, found)
    out = out.withColumn("__row", F.col(key).cast("string")).join(
        known.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
    return out.withColumn("__known", F.coalesce("__known", F.lit(False))).checkpoint()


def decide_claims(requests: DataFrame, unique_cols: Sequence[str], local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``requests`` (in total order) with __failed, the numbers of the columns whose value an earlier accepted request
    took. An accepted request takes all its values for good; nulls never clash.

    A request that is the first one of all its values is sure to be accepted, and its values are refused to all others
    by a join, however many ask for one. Only what hangs on undecided requests is replayed.
    """
    n = len(unique_cols)
    one = [[c] for c in range(n)]
    asked = requests.select(F.col(ORDER)["__number"].alias("id"), F.col(ORDER).alias("o"),
                            F.col(ORDER)["__number"].cast("string").alias("row"), _texts(unique_cols).alias("wanted"))
    tokens = asked.select("id", "o", F.explode(_tokens(F.col("wanted"), one, list(range(n)))).alias("t")).select(
        "id", "o", "t.i", "t.v")
    first = tokens.groupBy("i", "v").agg(F.min("o").alias("first"))
    late = tokens.join(first, ["i", "v"]).where(F.col("o") != F.col("first")).select("id").distinct().checkpoint()
    taken = tokens.join(late, "id", "left_anti").select("i", "v").distinct()
    live, probes, static = _with_static(asked.join(late, "id", "left_semi"), taken, n)
    found = replayed(live, live.limit(0).select("row", "wanted"), probes, one, list(range(n)), local_edges)
    return _judged(requests, static, found).checkpoint()


def accepted() -> Column:
    return F.size("__failed") == 0


def reasons(texts: Sequence[str]) -> Column:
    """The text of every failed constraint, joined."""
    return F.concat_ws("; ", F.transform("__failed", lambda i: F.get(F.array(*[F.lit(x) for x in texts]), i)))
