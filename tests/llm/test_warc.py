"""WARC round trip, revisit records and the merged capture index."""

import hashlib
import random

from llm_helpers import CLASHES
from hypothesis import given, settings
from hypothesis import strategies as st

from shopframe.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], "page_id long, url string, html string, "
                                 + ", ".join(f"`{c}` string" for c in CLASHES))


def rows():
    rng = random.Random(31)
    long = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>" * 40
    out = [(1, "http://www.B.org/x?y=1#f", long), (2, "https://a.b.org/", long), (9, "http://a.b.org", long),
           (3, "http://a.b.org/", "short"), (4, "http://c.org/", "short"), (5, None, None), (6, "http://[bad", ""),
           (7, "http://c.org/a\r\nb", "z" * 1000), (8, "http://c.org/b", "z" * 1000), (10, "u", "z" * 999),
           (11, "u", "z" * 999), (None, "http://n.org/", long), (12, "http://r.org/", "q" * 2000),
           (12, "http://r.org/", "q" * 2000)]
    return out + [(100 + i, f"http://h{rng.randrange(5)}.org/{rng.randrange(9)}", f"page {i}") for i in range(60)]


def test_rows_without_a_time_get_the_stand_in(spark, tmp_path):
    data = spark.createDataFrame([(1, "http://a.org/", "x", "2021-05-06 07:08:09"), (2, "http://a.org/", "y", None)],
                                 "page_id long, url string, html string, t string")
    out = W.archive_and_index(data, str(tmp_path / "w"), time_col="t").collect()
    assert {r.page_id: r.captured_at for r in out} == {1: "2021-05-06T07:08:09Z", 2: "2020-01-01T00:00:02Z"}


def wanted(data):
    last = {}
    for i, _, h in data:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    copies = [h for _, _, h in data]
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        to = last.get(h) if len(raw) >= 1000 and copies.count(h) > 1 else None
        revisit = to is not None and to != i
        out.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                    to if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    data = rows()
    path = str(tmp_path / "w")
    records = W.warc_records(pages(spark, data).repartition(4))
    W.write_warc(records, path, records_per_file=7)
    index = W.merged_index(W.capture_runs(spark, path), captures_per_range=20)
    out = index.collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out),
                  key=str) == wanted(data)
    assert len({r.run for r in out}) > 4 and len({r.range_id for r in out}) > 2
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0)
             for r in sorted(out, key=lambda r: (r.range_id, r.position))]
    assert order == sorted(order)
    keys = {r.page_id: r.url_key for r in out}
    assert keys[1] == "org,b)/x?y=1" and keys[2] == keys[9] == "org,b,a)/" and keys[5] == ""


def test_empty_table(spark, tmp_path):
    assert W.archive_and_index(pages(spark, rows()).limit(0), str(tmp_path / "e")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    tree = W.LoserTree([iter(sorted(r)) for r in runs], key=lambda x: x)
    assert list(tree) == sorted(x for r in runs for x in r)


def test_parse_keeps_offsets():
    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n"
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    found = list(W.parse_records(one * 3))
    assert [f[0] for f in found] == [0, len(one), 2 * len(one)] and all(f[2] == block for f in found)
