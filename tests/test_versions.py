"""Editorial commands on versions by cases: what changes, what is refused, what stays."""

from pyspark.sql import functions as F

from marginalia.operators import editorial as E
from marginalia.operators import versions as V

FIELDS = ["title", "content_mode", "pdf_pages"]
PAYLOAD = "struct<title:string,content_mode:string,pdf_pages:long>"


def run(spark, commands, articles, versions, blocks, payload_blocks):
    a = spark.createDataFrame([(*r, None, "old", "BLOCKS", None) for r in articles], "article long, owner long, status string, published long, pending long, published_at timestamp, title string, content_mode string, pdf_pages long")
    v = spark.createDataFrame([(*r, 0, 1, f"t{r[1]}", "BLOCKS", None) for r in versions], "article long, version long, status string, created_by long, minutes long, title string, content_mode string, pdf_pages long")
    b = spark.createDataFrame(blocks, "article long, version long, position int, kind string, content string")
    c = spark.createDataFrame(commands, f"seq long, article long, command string, actor long, role string, payload {PAYLOAD}")
    p = spark.createDataFrame(payload_blocks, "seq long, position int, kind string, content string")
    return V.applied(c, p, a, v, b, FIELDS, F.lit("2024-01-01").cast("timestamp"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


TEXT = '{"text": "%s"}'


def test_copies_saves_and_publications(spark):
    articles = [(1, 7, "PUBLISHED", 1, None), (2, 7, "DRAFT", None, 1), (3, 7, "PUBLISHED", 1, None), (4, 7, "PUBLISHED", 1, 2), (5, 7, "DRAFT", None, 1)]
    versions = [(1, 1, "PUBLISHED"), (2, 1, "REJECTED"), (3, 1, "PUBLISHED"), (4, 1, "PUBLISHED"), (4, 2, "PENDING_REVIEW"), (5, 1, "DRAFT")]
    blocks = [(1, 1, 0, "heading", TEXT % "h"), (1, 1, 1, "paragraph", TEXT % "p"), (2, 1, 0, "paragraph", TEXT % "gone"), (3, 1, 0, "paragraph", TEXT % "stays")]
    commands = [
        (1, 1, "revise", 7, "PUBLISHER", None), (2, 2, "save", 7, "PUBLISHER", ("new", "BLOCKS", None)), (3, 3, "edit_published", 9, "ADMIN", ("edit", "PDF", 4)),
        (4, 4, "approve", 9, "ADMIN", None), (5, 5, "publish", 9, "ADMIN", None),
    ]
    out = run(spark, commands, articles, versions, blocks, [(2, 0, "paragraph", TEXT % ("w " * 401)), (3, 0, "paragraph", TEXT % "pdf")])
    assert rows(out.decided, "seq", "code", "version") == [(1, None, 2), (2, None, 1), (3, None, 2), (4, None, 2), (5, None, 1)]
    assert rows(out.articles, "article", "status", "published", "pending", "title") == [
        (1, "PUBLISHED", 1, 2, "old"), (2, "DRAFT", None, 1, "new"), (3, "PUBLISHED", 2, None, "edit"), (4, "PUBLISHED", 2, None, "t2"), (5, "PUBLISHED", 1, None, "t1"),
    ]
    assert rows(out.versions, "article", "version", "status", "created_by", "minutes", "title") == [
        (1, 1, "PUBLISHED", 0, 1, "t1"), (1, 2, "DRAFT", 7, 1, "t1"), (2, 1, "REJECTED", 0, 3, "new"), (3, 1, "SUPERSEDED", 0, 1, "t1"), (3, 2, "PUBLISHED", 9, 8, "edit"),
        (4, 1, "SUPERSEDED", 0, 1, "t1"), (4, 2, "PUBLISHED", 0, 1, "t2"), (5, 1, "PUBLISHED", 0, 1, "t1"),
    ]
    assert rows(out.blocks, "article", "version", "position", "kind") == [(1, 1, 0, "heading"), (1, 1, 1, "paragraph"), (1, 2, 0, "heading"), (1, 2, 1, "paragraph"), (2, 1, 0, "paragraph"), (3, 1, 0, "paragraph"), (3, 2, 0, "paragraph")]
    assert out.blocks.filter("content LIKE '%gone%'").count() == 0
    assert rows(out.reviews, "article", "version", "actor", "action") == [(3, 2, 9, "PUBLISHED_DIRECT"), (4, 2, 9, "APPROVED"), (5, 1, 9, "PUBLISHED_DIRECT")]
    assert rows(out.notices, "article", "kind", "user_id") == [(5, "article_approved", 7), (5, "article_published", None)]


def test_refusals_change_nothing(spark):
    articles = [(1, 7, "PUBLISHED", 1, 2), (2, 7, "DRAFT", None, 1), (3, 7, "DRAFT", None, None), (4, 7, "DRAFT", None, 9), (5, 7, "DRAFT", None, 1), (6, 7, "DRAFT", None, 1), (7, 7, "DRAFT", None, 1)]
    versions = [(1, 1, "PUBLISHED"), (1, 2, "DRAFT"), (2, 1, "PENDING_REVIEW"), (5, 1, "DRAFT"), (6, 1, "DRAFT"), (7, 1, "DRAFT")]
    commands = [
        (1, 1, "revise", 7, "PUBLISHER", None), (2, 1, "approve", 9, "ADMIN", None), (3, 2, "save", 7, "PUBLISHER", ("x", "BLOCKS", 1)), (4, 3, "approve", 9, "ADMIN", None), (5, 4, "publish", 9, "ADMIN", None),
        (6, 5, "approve", 9, "ADMIN", None), (7, 6, "save", 8, "PUBLISHER", ("x", "BLOCKS", 1)), (8, 7, "publish", 7, "PUBLISHER", None), (9, 99, "publish", 9, "ADMIN", None),
    ]
    out = run(spark, commands, articles, versions, [(1, 1, 0, "paragraph", TEXT % "p")], [(3, 0, "paragraph", TEXT % "x")])
    assert [c for _, c in rows(out.decided, "seq", "code")] == ["REVISION_IN_PROGRESS", "CONFLICT", "VERSION_NOT_EDITABLE", "NO_PENDING_VERSION", "NOT_FOUND", "NOT_PENDING_REVIEW", "NOT_FOUND", "FORBIDDEN", "NOT_FOUND"]
    assert rows(out.articles, "article", "published", "pending") == rows(spark.createDataFrame([(a, p, n) for a, _, _, p, n in articles], "article long, published long, pending long"), "*")
    assert rows(out.versions, "article", "version", "status") == sorted(versions, key=repr)
    assert out.blocks.count() == 1 and out.reviews.count() == 0 and out.notices.count() == 0


def test_no_commands(spark):
    out = run(spark, [], [(1, 7, "DRAFT", None, 1)], [(1, 1, "DRAFT")], [(1, 1, 0, "paragraph", TEXT % "p")], [])
    assert [x.count() for x in out] == [0, 1, 1, 1, 0, 0]


def test_promotion_takes_submitted_versions_that_exist(spark):
    a = spark.createDataFrame([(1, None, 1, "old"), (2, 1, 2, "old"), (3, None, 9, "old"), (4, 1, None, "old")], "article long, published long, pending long, title string")
    v = spark.createDataFrame([(1, 1, "DRAFT", "d"), (2, 1, "PUBLISHED", "p"), (2, 2, "PENDING_REVIEW", "n"), (4, 1, "PUBLISHED", "q")], "article long, version long, status string, title string")
    articles, versions = E.promoted(a, v, ["title"])
    assert rows(articles, "article", "published", "pending", "title", "first_publish") == [(1, None, 1, "old", False), (2, 2, None, "n", False), (3, None, 9, "old", False), (4, 1, None, "old", False)]
    assert rows(versions, "article", "version", "status") == [(1, 1, "DRAFT"), (2, 1, "SUPERSEDED"), (2, 2, "PUBLISHED"), (4, 1, "PUBLISHED")]
    assert rows(E.promoted(a, v, ["title"], direct=True)[0], "article", "published", "first_publish")[0] == (1, 1, True)
