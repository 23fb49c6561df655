"""Archives and their index against plain Python."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import warc

SCHEMA = "page_id long, url string, html string, file string, urlkey string"


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        html = html or ""
        if page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        of = first.get(html or "")
        again = len(raw) >= least and of is not None and of != page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=repr)


def digest_columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_archive_and_index(spark, least):
    rows = [
        (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/x", "<p>one</p>"), (3, None, None), (4, "http://b.example/\r\ny", ""), (None, "http://c.example", "<p>one</p>"),
        (5, "http://www.a.example:80/X?q=Ü", "é\r\n\r\nWARC/1.1\r\n\r\n" * 5), (6, "", "  "), (7, "not a url", "short"), (8, "http://[bad", "short"), (8, "http://[bad", "short"), (9, "u" * 9000, "z" * 300_000),
    ]
    pages = spark.createDataFrame([(*r, "f", "k") for r in rows], SCHEMA)
    index = warc.archive_and_index(pages, least)
    assert digest_columns(index) == expected(rows, least)
    urls = {r.page_id: r.url for r in index.collect()}
    assert urls[3] is None and urls[4] == "http://b.example/%0D%0Ay" and urls[9] == "u" * 9000


def test_empty(spark):
    assert warc.archive_and_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_in_order(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.archive_and_index(pages)
    assert digest_columns(index) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_ranges_are_globally_ordered(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, f"http://{rnd.choice('aaab')}.example/{rnd.choice('xxxxy')}", f"p{i}") for i in range(400)]
    pages = spark.createDataFrame([(*r, "f", "k") for r in rows], SCHEMA).repartition(7)
    tmp = warc.Scratch(spark, "test")
    warc.write_archives(pages, tmp.folder("a"), tmp)
    runs = tmp.save(warc.read_runs(spark, tmp.folder("a")), "runs")
    merged = [tuple(r) for r in warc.merged_index(runs, range_captures=50, block_captures=8).orderBy("key_range", "place").collect()]
    assert len(merged) == 400 and len({r[11] for r in merged}) > 4
    assert [r[:3] for r in merged] == sorted(r[:3] for r in merged)


def test_base32(spark):
    texts = ["", "a", "é" * 99]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(warc.F.col("t"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), max_size=9), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_merge(runs, block):
    capture = lambda key, run: (str(key), "", key, None, "response", None, 0, "", run, 0, 0)
    blocks = []
    for k, keys in enumerate(runs):
        own = [capture(key, f"r{k}") for key in sorted(keys)]
        blocks += [(f"r{k}", own[i : i + block]) for i in range(0, len(own), block)]
    blocks.sort(key=lambda b: warc._order(b[1][0]))
    merged = [c[2] for c in warc.merge_blocks(iter(blocks))]
    assert merged == sorted(key for keys in runs for key in keys)
