"""Removal of long repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
from llm_helpers import documents, prose

from shopframe.llm import suffix_index as S


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        mark = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                mark[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mark, [0]))))
        out.append((len(r), int(mark.sum()), tuple(map(tuple, edges.reshape(-1, 2).tolist())),
                    bytes(np.frombuffer(r, np.uint8)[~mark])))
    return out


def got(frame):
    return Counter((r.id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept))
                   for r in frame.collect())


def test_equal_to_brute_force(spark, edge_rows):
    rng = random.Random(21)
    rows = list(edge_rows)
    source = prose(rng, 400)
    for i in range(40):  # cuts of one source at any place and of any length, some with a changed character
        a = rng.randrange(len(source) - 500)
        part = source[a:a + rng.randint(150, 500)]
        if i % 3 == 0:
            at = rng.randrange(len(part))
            part = part[:at] + "#" + part[at + 1:]
        rows.append((100 + i, prose(rng, rng.randint(0, 30)) + part + prose(rng, rng.randint(0, 30))))
    rows += [(200, "ab" * 300), (201, "é" * 250), (202, "x" * 199), (203, "y" * 200), (204, "y" * 200 + "z"),
             (205, "line of a period\n" * 40)]
    want = Counter((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], 200)))
    for batches in (1, 4):
        assert got(S.suffix_dedup(documents(spark, rows).repartition(3), batches=batches)) == want


def test_other_length_and_empty_table(spark):
    rng = random.Random(22)
    source = prose(rng, 100)
    rows = [(i, prose(rng, 10) + source[i * 7:i * 7 + 90] + prose(rng, 10)) for i in range(30)]
    want = Counter((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], 70)))
    assert got(S.suffix_dedup(documents(spark, rows), length=70, batches=2)) == want
    assert S.suffix_dedup(documents(spark, rows).limit(0)).collect() == []


def test_slices_do_not_change_the_anchors():
    rng = random.Random(23)
    texts = [prose(rng, n).encode() for n in (500, 10, 0, 900)]
    whole, cut = S.anchors(texts), S.anchors(texts, size=257)
    covered = lambda f: {(d, a + i, x) for d, a, n, x in zip(f["doc"], f["at"], f["n"], f["k2"])
                         for i in range(n)}
    assert covered(whole) == covered(cut)
    assert len(covered(whole)) == sum(max(0, len(t) - 199) for t in texts)


def test_levels_merge_geometrically(spark):
    index = S.SuffixIndex()
    for batch in range(7):
        index.add(spark.createDataFrame([(batch, 1), (99, 9)], "k1 long, k2 long"))
    sizes = [n for n, _ in index.levels]
    assert sum(sizes) == 7 and len(sizes) <= 4 and sizes == sorted(sizes, reverse=True)
    found = index.add(spark.createDataFrame([(3, 1), (50, 5)], "k1 long, k2 long"))
    assert [tuple(r) for r in found.collect()] == [(3, 1)]
