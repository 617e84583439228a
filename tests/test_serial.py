"""Conflicting requests equal one-by-one application: many small worlds in one batch, ties, missing orders, chains."""

import datetime as dt
import random

import pytest

from shopframe.operators import changes as M
from shopframe.operators import serial as S

T0 = dt.datetime(2024, 1, 20)
WORLDS = 60


def in_order(spark, frame, order):
    """The rows as Python tuples in the total order that the operators use."""
    def known(x):
        return (x is not None, x if x is not None else 0)
    rows = S.in_total_order(frame, order).collect()
    return sorted(rows, key=lambda r: tuple(known(x) for x in r["__o"]))


def one_by_one(base, requests, unique):
    """base {row: {col: value}}; requests [(row, {col: wanted}, tag)]. Returns (base, {tag: failed numbers or None})."""
    out = {}
    for row, wanted, tag in requests:
        if row not in base:
            out[tag] = None
            continue
        target = {c: (v if wanted.get(c) is None else wanted[c]) for c, v in base[row].items()}
        failed = [i for i, cols in enumerate(unique)
                  if any(wanted.get(c) is not None for c in cols) and all(target[c] is not None for c in cols)
                  and any(all(other[c] == target[c] for c in cols) for r, other in base.items() if r != row)]
        out[tag] = failed
        if not failed:
            base[row] = target
    return base, out


def worlds(seed, cols, values, rows=5, requests=9, nulls=0.25):
    rng = random.Random(seed)
    base, asked, tag = [], [], 0
    for w in range(WORLDS):
        free = {c: rng.sample(range(max(values, rows)), rows) for c in cols}
        if values < rows:  # few values: only the combination is unique
            pairs = rng.sample([(a, b) for a in range(values) for b in range(values)], rows)
            free = {c: [p[i] for p in pairs] for i, c in enumerate(cols)}
        for r in range(rows):
            base.append((w * 100 + r, *[None if rng.random() < 0.1 else f"{c}{w}-{free[c][r]}" for c in cols]))
        for _ in range(rng.randrange(requests)):
            tag += 1
            wanted = [None if rng.random() < nulls else f"{c}{w}-{rng.randrange(values)}" for c in cols]
            at = None if rng.random() < 0.1 else T0 + dt.timedelta(seconds=rng.randrange(4))
            asked.append((w * 100 + rng.randrange(rows + 1), *wanted, at, None if rng.random() < 0.1 else rng.randrange(3), tag))
    return base, asked


def frames(spark, base, asked, cols):
    text = ", ".join(f"{c} string" for c in cols)
    return (spark.createDataFrame(base, f"id int, {text}").repartition(3),
            spark.createDataFrame(asked, f"id int, {text}, change_ts timestamp, seq int, tag int").repartition(4, "tag"))


CASES = [(["name"], [["name"]], 7, 1_000_000), (["email", "phone"], [["email"], ["phone"]], 8, 1_000_000),
         (["fa", "en"], [["fa", "en"]], 3, 1_000_000), (["email", "phone"], [["email"], ["phone"]], 8, 0)]


@pytest.mark.parametrize("cols, unique, values, local", CASES)
def test_patches_equal_one_by_one(spark, cols, unique, values, local):
    base, asked = worlds(values, cols, values)
    b, a = frames(spark, base, asked, cols)
    ordered = in_order(spark, a, ["change_ts", "seq"])
    want, tags = one_by_one({r[0]: dict(zip(cols, r[1:])) for r in base},
                            [(r.id, {c: r[c] for c in cols}, r.tag) for r in ordered], unique)
    got = S.decide_patches(b, S.in_total_order(a, ["change_ts", "seq"]), "id", unique, local).collect()
    assert {r.tag: (list(r["__failed"]) if r["__known"] else None) for r in got} == tags and len(got) == len(asked)
    assert any(tags.values()) and any(t == [] for t in tags.values())
    if local:
        out = M.rename_unique(b, a, "id", cols) if len(unique) == 1 else M.patch_unique(b, a, "id", cols, cols)
        assert {r.id: {c: r[c] for c in cols} for r in out["base"].collect()} == want
        assert sorted(r.tag for r in out["rejected"].collect()) == sorted(t for t, f in tags.items() if f is None or f)


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_claims_equal_one_by_one(spark, local):
    rng = random.Random(5)
    asked = [(rng.choice([None, f"e{w}-{rng.randrange(4)}"]) if rng.random() < 0.3 else f"e{w}-{rng.randrange(6)}",
              f"p{w}-{rng.randrange(6)}", rng.choice([None, 1, 2, 3, 4, 5]), n)
             for n, w in enumerate(rng.choices(range(WORLDS), k=500))]
    a = spark.createDataFrame(asked, "email string, phone string, seq int, tag int").repartition(4, "tag")
    taken, want = [set(), set()], {}
    for r in in_order(spark, a, ["seq"]):
        want[r.tag] = [i for i, v in enumerate((r.email, r.phone)) if v is not None and v in taken[i]]
        if not want[r.tag]:
            taken[0].add(r.email)
            taken[1].add(r.phone)
    got = S.decide_claims(S.in_total_order(a, ["seq"]), ["email", "phone"], local)
    assert {r.tag: list(r["__failed"]) for r in got.collect()} == want
    res = M.first_of_batch(a, ["email", "phone"], "seq")
    good, bad = [r.tag for r in res["accepted"].collect()], [r.tag for r in res["rejected"].collect()]
    assert sorted(good) == sorted(t for t, f in want.items() if not f) and sorted(good + bad) == sorted(want)


def test_equal_and_missing_orders_accept_one(spark):
    users = spark.createDataFrame([(i, "customer") for i in range(4)], "id int, role string")
    sellers = spark.createDataFrame([], "id long, user_id int, shop_name string, status string")
    for at in (T0, None):
        asked = spark.createDataFrame([(i, "S", at, 1) for i in range(4)] + [(0, "S", at, 1)],
                                      "user_id int, shop_name string, change_ts timestamp, seq int")
        res = M.promote_sellers(users, sellers, asked)
        assert res["sellers"].count() == 1 and res["rejected"].count() == 4
        new = spark.createDataFrame([("x", "y", at, 1)] * 3, "fa_name string, en_name string, change_ts timestamp, seq int")
        base = spark.createDataFrame([], "id long, fa_name string, en_name string")
        res = M.create_unique(base, new, "categories", ["fa_name", "en_name"], "category")
        assert res["base"].count() == 1 and res["rejected"].count() == 2
        base = spark.createDataFrame([(1, "x")], "id int, name string")
        two = spark.createDataFrame([(1, "a", at, 1), (1, "b", at, 1)], "id int, name string, change_ts timestamp, seq int")
        assert M.rename_unique(base, two, "id", ["name"])["base"].count() == 1


def jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_chains_or_repeats(spark):
    counts = {}
    for n in (10, 1_000):
        base = spark.createDataFrame([(i, f"v{i}") for i in range(n + 1)], "id int, name string")
        # row i wants the name of row i + 1; the last one moves away first, and another row is renamed n times
        chain = [(n, "free", T0, 0)] + [(n - 1 - i, f"v{n - i}", T0, 1 + i) for i in range(n)]
        many = [(0, f"w{i}", T0, 2 * n + i) for i in range(n)]
        frame = spark.createDataFrame(chain + many, "id int, name string, change_ts timestamp, seq int")
        res, counts[n] = jobs(spark, f"chain-{n}", lambda: {r.id: r.name for r in M.rename_unique(
            base, frame, "id", ["name"])["base"].collect()})
        assert res == {**{i: f"v{i + 1}" for i in range(n)}, n: "free", 0: f"w{n - 1}"}
    assert counts[1_000] <= counts[10] + 2 and counts[1_000] < 60, counts
