"""Nulls, refusals and empty tables of the editorial commands and small readers."""

import hashlib
import hmac

from pyspark.sql import functions as F

from marginalia.operators import editorial as E
from marginalia.operators import reading as G


def test_submit_gate_takes_nulls_as_missing(spark):
    rows = spark.createDataFrame([(None, " ", None, None, None, None, None), ("t", "s", "a", 1, "PDF", 2, None)], "title string, summary string, author_name string, category int, content_mode string, pdf_media int, blocks int")
    assert [r[0] for r in rows.select(E.missing_to_submit()).collect()] == [["title", "summary", "author_name", "category", "blocks"], []]


def test_magazine_moves(spark):
    old = spark.createDataFrame([(1, 7, "a", 0), (2, 7, "b", 1), (3, 8, None, 5)], "article long, magazine long, section string, display_order long")
    asked = spark.createDataFrame([(1, None, None, False), (2, 8, None, False), (3, 8, "x", True), (4, 9, "n", True), (5, 8, None, False)], "article long, magazine long, section string, section_given boolean")
    got = {tuple(r) for r in E.reconciled(old, asked).select("article", "magazine", "section", "display_order").collect()}
    assert got == {(3, 8, "x", 5), (2, 8, None, 6), (5, 8, None, 7), (4, 9, "n", 0)}
    assert E.reconciled(old.limit(0), asked.limit(0)).count() == 0


def test_reorder_is_all_or_nothing(spark):
    old = spark.createDataFrame([(7, 1, 0), (7, 2, 1), (8, 3, 0)], "magazine long, article long, display_order long")
    new = spark.createDataFrame([(7, 1, 9), (7, 3, 4), (8, 3, 5)], "magazine long, article long, display_order long")
    assert {tuple(r) for r in E.reordered(old, new).collect()} == {(7, 1, 0), (7, 2, 1), (8, 3, 5)}


def test_signed_tokens(spark):
    rows = spark.createDataFrame([("user",), ("ü",), (None,)], "id string").withColumn("token", G.signed(F.col("id"), "key")).withColumn("back", G.signer(F.col("token"), "key"))
    for r in rows.collect():
        assert r["back"] == r["id"]
        assert r["token"] == (r["id"] and f"{r['id']}.{hmac.new(b'key', r['id'].encode(), hashlib.sha256).hexdigest()}")
    bad = spark.createDataFrame([("user",), (".",), ("",), (None,), ("user." + "0" * 64,)], "t string")
    assert [r[0] for r in bad.select(G.signer(F.col("t"), "key")).collect()] == [None] * 5


def test_readers_on_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None), (1, "a b"), (2, "x" * 100)], "k int, text string")
    assert sorted(tuple(r) for r in G.needs_ocr(pages, "k", "text").collect()) == [(1, 2, 2, True), (2, 1, 100, False)]
    assert G.needs_ocr(pages.limit(0), "k", "text").count() == 0
    assert sorted(tuple(r) for r in G.first_seen(pages, "k", "text", ["text"]).select("k", "place").collect()) == [(1, 1), (1, 2), (2, 1)]
    paths = spark.createDataFrame([("x/Vol 2/Issue_17.pdf",), ("a.pdf",)], "p string")
    assert [r[0] for r in paths.select(G.issue_key(F.col("p"))).collect()] == ["vol-2-issue-17", "a"]
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(G.page_file(F.lit(7)), G.page_file(F.lit(1234))))).collect()] == ["page-007", "page-1234"]
