"""The corpus pipeline: stages in order, each on what the one before kept, and the entry's guard."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers

import corpus_pipeline as C
from llm_helpers import CLASHES, documents
from shopframe.llm import packing as P

ROOT = Path(__file__).resolve().parents[2]


def test_stages_on_edge_rows(spark, edge_rows, tmp_path):
    docs = documents(spark, edge_rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = docs, []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < len(C.STAGES) - 1:
            assert after.columns == docs.columns
            kept.append({r.doc_id: r for r in after.collect()})
        now = after
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash", "substring_dedup", "packing"]
    # short, blank and repetitive texts go; of the copies of 1 the smallest id stays
    assert not {2, 3, 4, 9, 10, 11} & set(kept[0]) and {1, 5, 6, 8, 13} <= set(kept[0])
    assert {1, 8, 13} <= set(kept[1]) and 5 not in kept[1] and None not in kept[1]
    assert set(kept[2]) == set(kept[1])
    for r in kept[2].values():
        assert r.n_chars == len(r.text) and all(r[c] == "x" for c in CLASHES)
    encode = P.encoder(public_tokenizers.path(P.VOCABULARY))
    pieces = now.collect()
    for i, r in kept[2].items():
        assert sum(p.length for p in pieces if p.doc_id == i) == len(encode(r.text)) + 1
    assert sum(r.length for r in C.run(spark, str(tmp_path)).collect()) == sum(p.length for p in pieces)


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_entry_works_without_the_folder(tmp_path):
    """Without the training-data folders the other queries are still there."""
    code = ("import sys; sys.path.insert(0, sys.argv[1])\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('shopframe.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))")
    out = subprocess.run([sys.executable, "-c", code, str(ROOT)], capture_output=True, text=True, timeout=120, cwd=tmp_path)
    n, any_llm = out.stdout.split()
    assert int(n) > 100 and any_llm == "False"


def test_entry_has_every_query():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert {"op3_warc", "op9_topk_search"} <= set(e.oracle_sql())


def test_entry_works_without_a_module_of_the_folder():
    """Where a module that only the training-data operators need is missing, the other queries are still there."""
    code = ("import sys; sys.path.insert(0, sys.argv[1])\n"
            "sys.modules['zstandard'] = None\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()) > 100, any(k.startswith('op1') for k in e.queries()))")
    out = subprocess.run([sys.executable, "-c", code, str(ROOT)], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr
