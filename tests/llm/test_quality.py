"""Quality rules against a plain Python count, and the verdicts on clean and broken texts."""

import math
import random
import re
from collections import Counter

from llm_helpers import documents, prose

from shopframe.llm import quality as Q
from pyspark.sql import functions as F


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(hit))


def test_counts_equal_plain_python(spark, edge_rows):
    rows = edge_rows + [(20, "a # b\na # b\n*$%&|<>\n\n a # b"), (21, "x y z x y z x y z w")]
    out = Q.quality_rules(documents(spark, rows)).collect()
    got = Counter((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((i, *counts(t)) for i, t in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_clean_stays_and_broken_goes(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 150)) for i in range(40)]
    shout = [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 150).split())) for i in range(3)]
    signs = [(200 + i, " ".join(w + "$$$" for w in prose(rng, 150).split())) for i in range(3)]
    out = Q.quality_rules(documents(spark, clean + shout + signs), carry=["doc_id"])
    kept = {r.row.doc_id for r in out.where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_hot_source_is_not_its_own_reference(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, 200)) for i in range(30)]
    lists = [(1000 + i, " ".join("".join(rng.choices("aeioulnrstdm", k=rng.randint(4, 9))) for _ in range(150)))
             for i in range(120)]
    source = F.when(F.col("doc_id") >= 1000, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5))
    out = Q.quality_rules(documents(spark, clean + lists).withColumn("source", source), carry=["doc_id"])
    assert {r.row.doc_id for r in out.where("kept").collect()} == {i for i, _ in clean}


def test_unknown_language_missing_column_and_empty_table(spark):
    rng = random.Random(2)
    one = documents(spark, [(1, prose(rng, 120))]).withColumn("lang", F.lit(None).cast("string"))
    assert Q.quality_rules(one).first().kept
    assert Q.quality_rules(one.drop("lang")).first().kept
    assert Q.quality_rules(one.limit(0)).collect() == []


def test_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]

    def js(a, b):
        m = [(x + y) / 2 for x, y in zip(a, b)]
        kl = lambda u: sum(x * math.log2(x / z) for x, z in zip(u, m) if x)
        return math.sqrt((kl(a) + kl(b)) / 2)

    row = spark.createDataFrame([(p, q, [0.0, 0.0, 0.0])], "p array<double>, q array<double>, z array<double>").select(
        Q.jensen_shannon(F.col("p"), F.col("q")).alias("pq"), Q.jensen_shannon(F.col("p"), F.col("p")).alias("pp"),
        Q.jensen_shannon(F.col("p"), F.col("z")).alias("pz")).first()
    assert abs(row.pq - js(p, q)) < 1e-12 and row.pp == 0 and row.pz is None


def test_no_python_in_the_plan(spark, edge_rows):
    plan = Q.quality_rules(documents(spark, edge_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
