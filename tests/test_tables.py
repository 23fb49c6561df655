"""Readers and small rewrites of tables that no query uses."""

import json

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import blocks as B
from marginalia.operators import nested as N
from marginalia.operators import relational as R
from marginalia.sources import tables as S


def test_readers(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "page-002.txt").write_text("two\nlines")
    (tmp_path / "a" / "b" / "page-1234.txt").write_text("é")
    (tmp_path / "a" / "notes.txt").write_text("no page")
    (tmp_path / "a" / "~$x.docx").write_text("lock")
    pages = S.page_files(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page, r.text) for r in pages) == [(2, "two\nlines"), (1234, "é")]
    listed = S.listing(spark, str(tmp_path / "a")).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in listed) == ["notes.txt", "page-002.txt", "page-1234.txt"] and sum(r.bytes for r in listed) == 18
    (tmp_path / "d.json").write_text(json.dumps({"a": 1, "b": ["x"], "more": 2}))
    assert tuple(S.json_documents(spark, str(tmp_path / "d.json"), "a int, b array<string>").first()) == (1, ["x"])


def test_rewrites(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(R.update_where(old, F.col("k") == 2, v=F.lit("z"))) == [(1, "a"), (2, "z")]
    parents, children = R.delete_with_children(old, {"c": new}, new.filter("k = 2"), "k")
    assert rows(parents) == [(1, "a")] and rows(children["c"]) == [(3, "y")]
    assert rows(R.insert_absent(old.limit(0), new, ["k"])) == [(2, "x"), (3, "y")]


def test_expressions(spark):
    df = spark.createDataFrame([(["b", "a"], [("t", 1)], "<a href=\"x\">&", "vii", 3)], "items array<string>, blocks array<struct<old:string,n:int>>, html string, number string, pages int")
    row = df.select(N.renumbered(F.col("items"), 1).alias("r"), N.map_blocks(F.col("blocks"), {"new": "old"}).alias("m"), T.escape_html(F.col("html")).alias("e"), T.small_number(F.col("number")).alias("n"), B.minutes_of_pages(F.col("pages")).alias("p")).first()
    assert [tuple(x) for x in row.r] == [(1, "b"), (2, "a")] and row.m[0].asDict() == {"new": "t"} and row.e == "&lt;a href=&quot;x&quot;&gt;&amp;" and (row.n, row.p) == (7, 6)


def test_quality_warnings(spark):
    docs = spark.createDataFrame([(1, "c", "s", "A"), (2, None, " ", "H"), (3, "c", None, None)], "k int, category string, summary string, author string")
    blocks = [(1, 0, "paragraph", {"text": "w " * 60}), (1, 1, "paragraph", {"text": "w " * 60, "x": 1}), (2, 0, "list", {"items": ["a b", {"label": "c"}]}), (2, 1, "quote", {"text": "q", "attribution": "not counted"}), (2, 2, "formula", {"expression": "e", "note": "n"})]
    df = spark.createDataFrame([(k, p, t, json.dumps(c)) for k, p, t, c in blocks], "k int, position int, block_type string, content string")
    got = {r.k: (r.blocks, r.words, r.warnings) for r in B.quality_warnings(docs, df, "k", "H").collect()}
    assert got == {1: (2, 120, ["repeated paragraph"]), 2: (3, 4, ["few words", "no category", "no byline"]), 3: (0, 0, ["no blocks", "no summary"])}


def test_html_to_blocks(spark):
    html = "<html><head><title>no</title></head><body><h2>Head &amp; <b>more</b></h2><p>One<p>Two<ul><li>a</li><li>b</li></ul><!-- no --><blockquote>q</blockquote><script>no()</script></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    got = [(r.page_id, r.position, r.block_type, json.loads(r.content)) for r in B.html_to_blocks(df).orderBy("page_id", "position").collect()]
    assert got == [
        (1, 1, "heading", {"level": 2, "text": "Head & more"}), (1, 2, "paragraph", {"text": "One"}), (1, 3, "paragraph", {"text": "Two"}), (1, 4, "list", {"style": "unordered", "items": ["a", "b"]}), (1, 5, "quote", {"text": "q"}),
    ]
