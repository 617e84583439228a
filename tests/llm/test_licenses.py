"""License scan against plain Python over the same rules; every rule's shortest match passes its gates."""

import random
import re
import re._parser as parser
from collections import Counter

from llm_helpers import documents, prose

from shopframe.llm import licenses as L

RULES = L.signature_rules()


def plain(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in L.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    line = " " + " ".join(words) + " " if words else " "
    found = [(m.start(), m.end(), p, rule, label, c) for rule, label, pattern, _, p, c in RULES
             for m in re.finditer(pattern, line)]
    kept = [d for d in found if not any(
        e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
        and ((e[0], e[1]) != (d[0], d[1]) or (-e[2], e[3]) < (-d[2], d[3])) for e in found)]
    at = [i for i, _ in places]
    base = sorted({x for _, x in places})
    return (len(words), len(places), min(at, default=None), max(at, default=None), tuple(base),
            tuple(sorted({*base, *(d[4] for d in kept)})), max((d[5] for d in kept), default=0.0))


def shortest(tree):
    out = ""
    for op, a in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(a)
        elif name == "IN":
            kind, value = a[0]
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else "x"
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "MAX_REPEAT":
            out += shortest(a[2]) * a[0]
        elif name == "SUBPATTERN":
            out += shortest(a[3])
        elif name == "BRANCH":
            out += shortest(a[1][0])
        else:
            raise ValueError(name)
    return out


def samples():
    cut = len("(?<= )(?:"), -len(")(?= )")
    return [shortest(parser.parse(r[2][cut[0]:cut[1]])) for r in RULES]


def test_every_rule_passes_its_gates():
    assert len(RULES) > 200
    for rule, text in zip(RULES, samples()):
        line = f" {text} "
        assert re.search(rule[2], line), rule
        assert rule[3] in line.split(), rule
        assert any(g in line for g in L.GATES), rule


def test_equal_to_plain_python(spark, edge_rows):
    rng = random.Random(41)
    rows = list(edge_rows) + [(500 + i, s) for i, s in enumerate(samples())]
    rows += [(2000, "CC BY cc by mit license MIT-License, Apache License Apache-2.0 gnu general public license gnu general"),
             (2001, "licence by cc"), (2002, "mit license " * 300), (2003, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only")]
    for i in range(60):
        words = prose(rng, 40).split(" ")
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(samples()).title())
        rows.append((3000 + i, " ".join(words)))
    out = L.license_scan(documents(spark, rows)).collect()
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.labels), r.score)
                  for r in out)
    assert got == Counter((i, *plain(t)) for i, t in rows)


def test_native_and_empty(spark, edge_rows):
    out = L.license_scan(documents(spark, edge_rows).limit(0))
    plan = out._jdf.queryExecution().toString()
    assert out.collect() == [] and "Python" not in plan and "Pandas" not in plan
