"""SimHash groups against all pairs; the covering property of the Golay keys over all cosets."""

import random
from itertools import combinations

import numpy as np
import xxhash
from llm_helpers import documents, prose

from shopframe.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, bits=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            parent[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_groups_equal_all_pairs(spark, edge_rows):
    rng = random.Random(3)
    rows = list(edge_rows)
    for i in range(30):
        words = prose(rng, 150).split(" ")
        for j in range(4):
            rows.append((100 + 10 * i + j, " ".join(words)))
            words[rng.randrange(len(words))] = "changed"
    out = S.simhash_components(documents(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(i), p, c) for (i, _), p, c in zip(rows, prints, groups([i for i, _ in rows], prints)))
    assert sorted((str(r.id), r.fingerprint % 2 ** 64, r.component_id) for r in out) == want


def test_one_row_of_each_group_stays(spark, edge_rows):
    docs = documents(spark, edge_rows)
    kept = S.one_of_each_group(docs).collect()
    prints = [plain_fingerprint(t) for _, t in edge_rows]
    names = groups([i for i, _ in edge_rows], prints)
    assert sorted(r.doc_id for r in kept) == sorted({n for n in names if n is not None})
    assert set(kept[0].asDict()) == set(docs.columns)


def test_groups_without_ids_and_ids_of_several_texts(spark):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in (100, 101, 102)]
    prints = [plain_fingerprint(t) for t in near]
    assert len(set(prints)) > 1 and len(set(groups([1, 2, 3], prints))) == 1
    one, other = prose(rng, 200), prose(rng, 200)
    kept = S.one_of_each_group(documents(spark, [(None, t) for t in near] + [(7, one), (7, other)])).collect()
    assert sorted(r.text for r in kept if r.doc_id == 7) == sorted([one, other])
    assert len([r for r in kept if r.doc_id is None]) == 1


def test_chain_in_a_dense_group(spark):
    """Fingerprints in a chain of four-bit steps and a dense ball, as one component each."""
    rng = random.Random(5)
    chain, ball = [rng.getrandbits(64)], [rng.getrandbits(64)]
    for _ in range(20):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    ball += [ball[0] ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)]
    signed = [(x - 2 ** 64 if x >> 63 else x,) for x in {*chain, *ball}]
    links = S.fingerprint_links(spark.createDataFrame(signed, "p long"))
    components = S.connected_components(links).collect()
    assert len({r.component for r in components}) == 2
    assert len(components) == len(signed)
    assert links.count() < 4000  # the ball has 45,000 pairs


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert S.simhash_components(docs).collect() == []
    assert S.one_of_each_group(docs).collect() == []


def test_golay_covering():
    leaders, _, count = S.golay_tables()
    assert sorted(set(count.tolist())) == [1, 6]
    mine, n = S.nearby(leaders)
    slot = np.arange(6)
    for weight in (0, 1, 2):
        for bits in combinations(range(23), weight):
            other = leaders ^ sum(1 << b for b in bits)
            theirs, m = S.nearby(other)
            same = (mine[:, :, None] == theirs[:, None, :]) & (slot < n[:, None])[:, :, None] & (slot < m[:, None])[:, None]
            assert same.any((1, 2)).all()
            if weight < 2:
                assert ((mine == S.decoded(other)[:, None]) & (slot < n[:, None])).any(1).all()
