"""Paragraph deduplication: planted passages, near-equal lines against all pairs, clean documents untouched."""

import random
from itertools import combinations

from llm_helpers import documents, prose

from shopframe.llm import paragraphs as P


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def line(rng, n):
    return prose(rng, n).replace("\n", "")


def test_planted_passages_and_near_lines(spark, edge_rows):
    rng = random.Random(11)
    clean = [(1000 + i, prose(rng, 150)) for i in range(30)]
    passage = line(rng, 60)
    holders = []
    for i in range(6):  # in the middle of other lines
        w = line(rng, 80).split()
        holders.append((2000 + i, " ".join(w[:33 + i] + passage.split() + w[33 + i:])))
    near = []
    for g in range(5):  # lines with a word or two changed, many of them of one source
        source = line(rng, 60).split()
        for i in range(60 if g == 0 else 4):
            w = list(source)
            for _ in range(1 + i % 2):
                w[rng.randrange(len(w))] = f"edit{i}"
            near.append((3000 + 100 * g + i, " ".join(f"h{g}x{i}x{j}" for j in range(9)) + "\n" + " ".join(w)))
    rows = clean + holders + near
    out = {r.doc_id: r for r in P.paragraph_dedup(documents(spark, rows)).collect()}
    for i, text in clean:
        assert out[i].text == text and out[i].n_removed == 0 and out[i].kept_in == []
    words = passage.split()
    for i, text in holders:
        there = sum(" ".join(words[j:j + 4]) in out[i].text for j in range(len(words) - 3))
        if i == 2000:
            assert out[i].text == text
        else:
            assert there < 0.5 * len(words) and 2000 in out[i].kept_in
    kept = [ln for i, text in near for ln in text.split("\n")[1:] if ln in out[i].text]
    assert all(jaccard(a, b) < 0.8 for a, b in combinations(kept, 2))
    linked = {a for (_, a), (_, b) in combinations([(i, t.split("\n")[1]) for i, t in near], 2) if jaccard(a, b) >= 0.8}
    linked |= {b for (_, a), (_, b) in combinations([(i, t.split("\n")[1]) for i, t in near], 2) if jaccard(a, b) >= 0.8}
    for i, text in near:
        whole = text.split("\n")[1]
        if whole not in linked:
            assert text.split("\n")[0] in out[i].text
    for g in range(5):
        assert out[3000 + 100 * g].n_removed == 0  # the first of each group stays


def test_edge_rows(spark, edge_rows):
    docs = documents(spark, edge_rows)
    out = P.paragraph_dedup(docs).collect()
    assert len(out) == len(edge_rows) and set(docs.columns) <= set(out[0].asDict())
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    base = edge_rows[0][1]
    assert by_id[1][0].text == base and by_id[2][0].text is None and by_id[3][0].text == ""
    assert by_id[4][0].text == edge_rows[3][1] and by_id[8][0].text == edge_rows[10][1]
    assert len({r.text for r in by_id[5]}) == 1 and len(by_id[5][0].text) < len(base) / 2
    assert P.paragraph_dedup(docs.limit(0)).collect() == []


def test_units_do_not_depend_on_neighbours():
    rng = random.Random(12)
    texts = [prose(rng, n).encode() for n in (5, 40, 300, 0, 90)]
    together = P.paragraph_units(texts)
    for i, t in enumerate(texts):
        alone = P.paragraph_units([t])
        part = together[together["doc"] == i]
        for c in ("start", "end", "c1", "c2"):
            assert sorted(alone[c]) == sorted(part[c])


def test_bands_reach_the_recall():
    for rows in (1, 2, 3, 4):
        b = P.bands_for(0.8, rows, 0.999)
        assert 1 - (1 - 0.8 ** rows) ** b >= 0.999 > 1 - (1 - 0.8 ** rows) ** (b - 1)


def test_staying_places_stand(spark):
    """A block of a removed line is no place to stay."""
    rng = random.Random(13)
    block = [f"b{i}" for i in range(80)]
    source = line(rng, 1000).split()
    edited = source[:400] + block + source[480:]
    third = line(rng, 90).split()
    held = third[:40] + block + third[40:]
    cut = [set(zip(u["c1"], u["c2"])) for u in (P.paragraph_units([" ".join(w).encode()]) for w in (edited, held))]
    assert cut[0] & cut[1]
    inner = line(rng, 100).split()
    longer = [f"x{i}" for i in range(9)] + inner + [f"y{i}" for i in range(9)]
    rows = [(1, " ".join(source)), (2, " ".join(edited)), (3, " ".join(held)), (4, " ".join(longer)), (5, " ".join(inner))]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 and jaccard(rows[3][1], rows[4][1]) >= 0.8
    out = {r.doc_id: r for r in P.paragraph_dedup(documents(spark, rows)).collect()}
    assert out[2].text == "" and out[2].kept_in == [1]
    assert out[3].text == rows[2][1] and out[3].kept_in == []
    assert out[4].text == rows[3][1] and out[5].text == "" and out[5].kept_in == [4]


def test_units_name_their_line():
    rng = random.Random(14)
    units = P.paragraph_units([prose(rng, 300).encode(), line(rng, 200).encode()])
    assert (units["line"] <= units["start"]).all() and (units["end"] <= units["line_end"]).all()
    whole = units[units["bands"].notna()]
    assert (whole["line"] == whole["start"]).all() and (whole["line_end"] == whole["end"]).all()


def test_copies_without_ids(spark):
    text = line(random.Random(15), 40)
    out = P.paragraph_dedup(documents(spark, [(None, text)] * 3)).collect()
    assert sorted(r.text for r in out) == ["", "", text] and all(r.kept_in == [] for r in out)


def crowded(seed):
    """Lines that share a passage of varying length, some of them near copies of each other."""
    rng = random.Random(seed)
    passage, out = line(rng, 40).split(), []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(rng.randrange(3, 16))]
        out.append(passage[rng.randrange(4):] + own)
        if i % 4 == 0:
            out.append([*out[-1], f"more{i}"])
    return [" ".join(w) for w in out]


def test_crowded_pairs_lose_none_at_the_threshold(spark):
    texts = crowded(16)
    sets = [P.shingle_hashes(t).tolist() for t in texts]
    rows = [(i, key, i, i % 50 if i % 50 else 1, 1, s) for i, s in enumerate(sets) for key in (7, 8) if key == 7 or i % 3]
    frame = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)],
                                  "row long, key long, node long, label long, top long, s array<long>")
    for threshold in (0.5, 0.8, 1.0):
        near = {(a, b) for (a, x), (b, y) in combinations([(i, set(s)) for i, s in enumerate(sets)], 2)
                if len(x & y) >= threshold * len(x | y) and (a % 50 or 1) != (b % 50 or 1)}
        found = {(min(r), max(r)) for r in map(tuple, P._crowded_pairs(frame, threshold).collect())}
        assert near <= found and (near or threshold == 1.0)
    found = P._crowded_pairs(frame, 0.8).count()
    assert 0 < found < 0.25 * len(list(combinations(sets, 2)))  # all of them were compared before


def test_crowded_bands_link_as_others_do(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(crowded(17))]
    docs = documents(spark, rows)
    few = sorted(map(str, P.paragraph_dedup(docs).collect()))
    monkeypatch.setattr(P, "CROWDED", 2)
    assert sorted(map(str, P.paragraph_dedup(docs).collect())) == few
    monkeypatch.setattr(P, "CROWDED", 10_000)
    assert sorted(map(str, P.paragraph_dedup(docs).collect())) == few
    assert any("n_removed=1" in r for r in few) and any("n_removed=0" in r for r in few)
