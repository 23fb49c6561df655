"""Titles, bylines and blocks of issues on small cases: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import issues

BLOCKS = "k int, at int, kind string, text string"
OPERATORS = [issues.synopsis_callouts, issues.drop_caps_restored, issues.author_in]


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("title, bad", [(None, True), ("", True), ("Short", True), ("A Fair Title for Once", False), ("AAbboouuttEEnneerr", True), ("Power Sector Reform and", True), ("volume iv of the thing", True), ("Cover Story", True), ("Storage Tutorial Thermal", True), ("InMduesettriyng Days", True)])
def test_garbled(spark, title, bad):
    assert one(spark, issues.garbled, title) is bad


@pytest.mark.parametrize("title, want", [(None, None), ("", ""), ("THE GDP OF A STATE/UPS-DRIVE", "The GDP of a State/UPS-Drive"), ("As It Was", "As It Was"), (" (LCP) 2021: OF ", "(Lcp) 2021: Of"), ("1999", "1999")])
def test_title_case(spark, title, want):
    assert one(spark, lambda c: issues.title_case(c, ["gdp", "ups"]), title) == want


@pytest.mark.parametrize("line, yes, name", [("By Tobin Marsh", True, "Tobin Marsh"), ("E Vandermeer, Chairman of X.", False, "E Vandermeer"), ("-Mr Lionel K Ferro", True, "Mr Lionel K Ferro"), ("NEWS TODAY", False, "NEWS TODAY"), (None, False, None), ("", False, None), ("The New Grid", False, None)])
def test_byline(spark, line, yes, name):
    assert (one(spark, issues.is_byline, line), one(spark, issues.byline_name, line)) == (yes, name)


def run(spark, f, rows):
    return sorted(map(tuple, f(spark.createDataFrame(rows, BLOCKS), "k", "at", "kind", "text").collect()), key=repr)


def test_labels_in_a_row_pair_up(spark):
    rows = [(1, i, "paragraph", t) for i, t in enumerate(["Synopsis", "Synopsis 2", "SYNOPSIS 3", "the body", None])] + [(2, 0, "image", "Synopsis"), (2, 1, "paragraph", "synopsis"), (2, 2, "image", "x")]
    assert run(spark, issues.synopsis_callouts, rows) == [
        (1, 0, "callout", "Synopsis", "Synopsis 2"), (1, 2, "callout", "SYNOPSIS 3", "the body"), (1, 4, "paragraph", None, None),
        (2, 0, "image", None, "Synopsis"), (2, 1, "paragraph", None, "synopsis"), (2, 2, "image", None, "x"),
    ]


def test_drop_cap_comes_back(spark):
    rows = [(1, 0, "heading", "H"), (1, 1, "paragraph", "re you a"), (1, 2, "image", None), (1, 3, "paragraph", "Aconsumer?"), (2, 0, "paragraph", "re you."), (2, 1, "paragraph", "Aconsumer"), (3, 0, "paragraph", None), (3, 1, "paragraph", "Aconsumer")]
    got = run(spark, issues.drop_caps_restored, rows)
    assert [r for r in got if r[0] == 1] == [(1, 0, "heading", "H"), (1, 1, "paragraph", "Are you a consumer?"), (1, 2, "image", None)]
    assert [r for r in got if r[0] != 1] == sorted(rows[4:], key=repr)


def test_author_before_prose_only(spark):
    rows = [(1, 0, "image", None), (1, 1, "paragraph", "by Anil Kumar, Director"), (2, 0, "paragraph", "p" * 61), (2, 1, "paragraph", "By Anil Kumar"), (3, 4, "paragraph", "Jo Berg"), (3, 5, "paragraph", "Anil Kumar")]
    assert run(spark, issues.author_in, rows) == [(1, 1, "Anil Kumar"), (3, 4, "Jo Berg")]


@pytest.mark.parametrize("f", OPERATORS)
def test_empty(spark, f):
    assert run(spark, f, []) == []


def test_offsets_between_marks(spark):
    elements = spark.createDataFrame([(1, 0, "abc"), (1, 1, None), (1, 2, "de")], "k int, at int, text string")
    points = spark.createDataFrame([(1, 0), (1, 3), (1, 4), (1, 5), (1, 99), (1, 99), (1, -1), (2, 0)], "k int, place int")
    got = sorted(map(tuple, issues.elements_at(points, elements, "k", "at", "text", "place").collect()), key=repr)
    assert got == sorted([(1, 0, 0), (1, 3, 0), (1, 4, 1), (1, 5, 2), (1, 99, 2), (1, 99, 2), (1, -1, None), (2, 0, None)], key=repr)


def test_ranges_without_pages(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")], "k int, page int, text string")
    ranges = spark.createDataFrame([(1, 7, 1, 3), (1, 8, 3, 9), (1, 9, 3, 2), (2, 7, 1, 1)], "k int, entry int, start int, end int")
    got = {(r.k, r.entry): r.text for r in issues.text_of_ranges(ranges, pages, "k", "page", "text", "entry").collect()}
    assert got == {(1, 7): "\na\n\nc", (1, 8): "\nc", (1, 9): "", (2, 7): ""}
