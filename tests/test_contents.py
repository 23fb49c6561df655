"""Contents pages, page numbers, covers, front pages and folded entries by cases, and on empty tables."""

import random

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import contents as C
from marginalia.operators import frontpages as P
from marginalia.operators import issues as I  # noqa: E741
from marginalia.operators import pages as G
from marginalia.operators import reading as R

ABOUT = "about the review"


def pages_of(spark, *texts, issue="i"):
    return spark.createDataFrame([(issue, k + 1, t) for k, t in enumerate(texts)], "issue string, page long, text string")


def test_entries_take_two_lines_before_and_their_section(spark):
    text = "x 9\nTABLE OF CONTENTS\nEditorial  2\nCOVER STORY:\nlost\none\n two \nthree 3\n\n* star 4\nConsumers’ Desk.\nab 1\nx 0\nLast  of all\t5"
    got = C.contents_entries(pages_of(spark, None, text, "Next page 2", "", "end"), ABOUT).orderBy("entry").collect()
    assert [(r.section, r.title, r.folio) for r in got] == [
        ("Editorial", "Editorial", 2), ("Cover Story", "one two three", 3), ("Consumer Desk", "x 0 Last of all", 5), ("Consumer Desk", "Next page", 2),
    ]


def test_contents_without_heading_need_three_numbered_lines_in_the_first_pages(spark):
    listed = "a b 1\nc d 2\ne f 3"
    assert C.contents_pages(pages_of(spark, "x 1\ny 2", listed, "z")).first()[1:] == (3, 2, False)
    assert C.contents_pages(pages_of(spark, *["x"] * 4, listed)).first()["contents_page"] is None
    assert C.contents_entries(pages_of(spark, *["x"] * 4, listed), ABOUT).count() == 0
    assert C.contents_entries(pages_of(spark, "x").limit(0), ABOUT).count() == 0


def test_page_numbers_vote_and_the_first_cast_wins(spark):
    texts = ["x", "5\nx", "x\n\n 6 \n", "1\nx\ny\nz\n7", "x\n2\ny\nz\n99\nu\nv", None]
    got = C.folio_offsets(C.page_facts(pages_of(spark, *texts))).first()
    assert tuple(got)[1:] == (3, 2, 4)  # pages 2 and 3 say 3; 4 and 5 say -3
    assert C.folio_offsets(C.page_facts(pages_of(spark, "x"))).count() == 0


def test_covers_give_way_to_names_and_folders(spark):
    pages = pages_of(spark, "The Review\nVolume 11, Issue 14\nBright Days\n2021\nTable of Contents\nno", "Nov.-Dec., 2021").unionByName(pages_of(spark, "x", issue="j"))
    files = spark.createDataFrame([("i", "V1_I13 x", "Volume 1"), ("j", "V2 y", "other"), ("k", "x", "Volume IV")], "issue string, file_name string, folder string")
    got = {r.issue: tuple(r)[1:] for r in C.cover_facts(pages, files, "the review").collect()}
    assert got["i"] == (1, 13, "Nov.-Dec. 2021", "Bright Days", ["cover has volume 11, file name has 1", "cover has issue 14, file name has 13"])
    assert got["j"] == (2, None, None, None, []) and got["k"][:2] == (4, None)


def test_manifest_cuts_the_last_article_and_warns(spark):
    texts = ["Volume II Issue 3\nJan 2020\nTable of contents\nAbout the Review 2\nFirst one 3\nSecond one 40\nGone 45"] + [f"x\n{k}" for k in range(2, 71)]
    files = spark.createDataFrame([("i", "scan", "Volume 2")], "issue string, file_name string, folder string")
    pages = pages_of(spark, *texts)
    got = [tuple(r)[1:] for r in C.article_ranges(pages, ABOUT).orderBy("index").collect()]
    assert got == [(0, "About", "About the Review", 2, 2, None, True), (1, "Feature Article", "First one", 3, 39, None, False), (2, "Feature Article", "Second one", 40, 44, None, False), (3, "Feature Article", "Gone", 45, 69, 70, False)]
    row = C.manifests(pages, files, ABOUT, "the review").first()
    assert (row.volume, row.number, row.period, row.pages, row.offset, row.agreement, row.articles, row.warnings, row.confidence) == (2, 3, "Jan 2020", 70, 0, 1.0, 4, ["long: First one", "capped: Gone"], "review")
    bare = C.manifests(pages_of(spark, "x"), spark.createDataFrame([("i", "scan", "-")], "issue string, file_name string, folder string"), ABOUT, "the review").first()
    assert bare.warnings == ["no volume", "no issue number", "no period", "no contents", "no entries", "page numbers on 0 pages"] and bare.confidence == "review"


def front(spark, text):
    return tuple(P.front_pages(pages_of(spark, text), ["page"], "text", f"^{ABOUT}$", ["^the review"]).first())[1:]


def test_front_pages(spark):
    body = "word " * 20
    assert front(spark, f"THE REVIEW, June\n12\nCover  Article.\nA Headline of\ntwo lines\n-Mr Jo Van Berg, Director\n{body}") == ("A Headline of two lines", "Mr Jo Van Berg", "Cover Story", True, None)
    assert front(spark, f"Does it end here?\nProf. Ada Moe\n{body}") == ("Does it end here?", "Ada Moe", None, True, None)
    assert front(spark, f"Feature Story\nOne line of head\nFormer chairman\nDr. Ada Moe\n{body}")[:2] == ("One line of head Former chairman", "Ada Moe")
    assert front(spark, f"Tutorial\nends. Like this.\nDirector of works\nAda Moe\n{body}")[:3] == ("ends. Like this.", "Ada Moe", "Tutorial")
    assert front(spark, "Editorial\nSome Head\nAda Moe") == (None, None, "Editorial", False, None)
    assert front(spark, "Ada Moe\nlater") == (None, None, None, False, "no headline")
    assert front(spark, body) == (None, None, None, False, "no headline")
    assert front(spark, "a\nb\nc\nd\ne") == ("a b c d", None, None, False, "unverified")
    assert front(spark, "short head\nabout it Introduction to all")[0] == "short head about it"
    assert front(spark, None) == (None, None, None, False, "no text") and front(spark, "") == (None, None, None, False, "no headline")


def test_words_of_ascii_bound_the_rules(spark):
    df = spark.createDataFrame([("Ein langes éon",), ("Ein langes eon",), ("Ein langes on",)], "t string")
    assert [r[0] for r in df.select(I.garbled(df.t)).collect()] == [True, False, True]


def test_orphans_fold_by_titles_and_starts(spark):
    def merged(*rows):
        df = spark.createDataFrame([("i", *r) for r in rows], "issue string, title string, start_page long, end_page long")
        return [tuple(r)[1:] for r in G.merge_orphans(df).orderBy("start_page").collect()]

    assert merged((None, 1, 4), ("A", 5, 9), ("a", 10, 12), ("B", 11, 14)) == [("A", 1, 12, 3, None), ("B", 11, 14, 1, None)]
    assert merged((None, 1, 4)) == [(None, 1, 4, 1, None)] and merged((" ", 1, 2), (None, 3, 4)) == [(None, 1, 4, 2, None)]
    assert merged(("A", 1, 60), ("B", 1, 62), ("C", 61, 120)) == [("A", 1, 62, 2, "entry lost"), ("C", 61, 120, 1, "back matter")]
    assert merged(("A", 1, 2), ("B", 3, 4), ("A", 5, 6)) == [("A", 1, 2, 1, None), ("B", 3, 4, 1, None), ("A", 5, 6, 1, None)]


def test_points_keep_their_rows_and_find_the_first_range(spark):
    points = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 7, "y"), (2, 1, "z"), (1, None, "n"), (None, 5, "k")], "k long, at long, range_id string")
    ranges = spark.createDataFrame([(1, 9, 4, 5), (1, 8, 5, 9), (1, 7, 5, 5), (1, 6, 3, 1)], "k long, range_id long, start long, end long")
    got = sorted((r[0] or 0, r[1] or 0, r[-1]) for r in R.containing(points.withColumnRenamed("range_id", "note"), ranges, "k", "at").collect())
    assert got == [(0, 5, None), (1, 0, None), (1, 5, 9), (1, 5, 9), (1, 7, 8), (2, 1, None)]
    rng = random.Random(5)
    ps = [(rng.randint(0, 2), rng.randint(0, 30)) for _ in range(300)]
    rs = [(rng.randint(0, 2), i, s, s + rng.randint(-1, 8)) for i, s in enumerate(rng.randint(0, 30) for _ in range(40))]
    want = sorted((k, p, min(((s, i) for k2, i, s, e in rs if k2 == k and s <= p <= e), default=(0, None))[1] or -1) for k, p in ps)
    found = R.containing(spark.createDataFrame(ps, "k long, at long"), spark.createDataFrame(rs, "k long, range_id long, start long, end long"), "k", "at").collect()
    assert sorted((r.k, r["at"], r.range_id or -1) for r in found) == want


def test_lines_of_contents_are_made_once(spark):
    """Spark puts a test of the array below an inner explode, which makes all lines again for each mention of them."""
    plan = C.contents_entries(pages_of(spark, "Table of contents\na 1"), ABOUT)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "size(" not in plan.split("Generate posexplode")[1].split("Aggregate")[0]


def test_outer_lines_and_ends_equal_those_of_all_lines(spark):
    rnd = random.Random(8)
    bits = ["\n", "\n", "\r\n", "\r", " ", "\t", "\x0b", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "7", "é", "x", "😀"]
    texts = [None, "", "x", *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(900))]
    lines = F.filter(T.lines_of(F.col("t")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "") != "")
    margin = F.concat(F.slice(lines, 1, 2), F.reverse(F.slice(F.reverse(lines), 1, 2)))
    bare = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    first = lambda x: T.tidy_ends(F.get(F.filter(x, T.is_folio), F.lit(0)))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", first(T.outer_lines(F.col("t"))).alias("a"), first(margin).alias("b"), T.tidy_ends(F.col("t")).alias("c"), bare.alias("d")).collect()
    assert sum(r.b is not None for r in rows) > 50
    assert [(r.t, r.a, r.c) for r in rows] == [(r.t, r.b, r.d) for r in rows]


def test_labels_of_magazines_with_short_names(spark):
    rows = spark.createDataFrame([("News  and\tevents:",), ("NEWSY",), ("a b",), ("ab",), ("",), ("Über",)], "t string")
    assert [r[0] for r in rows.select(C.section_label(F.col("t"), "a b")).collect()] == ["News and Events", None, "About", None, None, None]
    assert [r[0] for r in rows.select(C.section_label(F.col("t"), ABOUT)).collect()] == ["News and Events", None, None, None, None, None]
