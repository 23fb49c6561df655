"""Named queries over the driver's tables, each beside the SQL that says the same.

The tables stand for a publishing corpus: orders are articles (F published, P in review, O draft), customers are users, nations
categories, suppliers magazines, lineitem their placements, parts topics, conversations versions and blocks, documents the
searchable texts, events reads, comments and hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import blocks as B
from marginalia.operators import nested as N
from marginalia.operators import pages as P
from marginalia.operators import relational as R
from marginalia.operators import search as S
from marginalia.operators import workflow as W
from marginalia.plans import contents, editorial, issues, migration, search, segments, sessions, versions  # noqa: F401 (register their queries)
from marginalia.plans.registry import oracle_sql, queries, query  # noqa: F401
from marginalia.sources.tables import table
from marginalia.streaming import stateful as Z

SEARCH = 'thon or thth "of the" -worthless'
KEYWORDS = {"alpha": ["thon", "ther", "tion"], "beta": ["ung", "keit", "sch"], "gamma": ["eau", "ment", "que"]}
HOUR_US = 3_600_000_000


def _published(spark: SparkSession, d: str) -> DataFrame:
    return R.where_given(table(spark, d, "orders"), o_orderstatus="F")


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query("""
    WITH m AS (SELECT o_orderkey, o_orderdate, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
               WHERE o_orderstatus = 'F' AND n_regionkey = 2)
    SELECT o_orderkey AS article, strftime(o_orderdate, '%Y-%m-%d') AS published_on, c_name AS author, n_name AS category, (SELECT count(*) FROM m) AS total
    FROM m ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def published_list_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 of the published articles of a region's categories, newest first, with the total. The page is the feature."""
    rows = _published(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = R.where_given(rows, n_regionkey=2, c_mktsegment=None)
    found = R.page_of(rows.select("o_orderkey", "o_orderdate", "c_name", "n_name"), [F.desc("o_orderdate"), F.asc("o_orderkey")], page=2)
    return found.select(F.col("o_orderkey").alias("article"), _day("o_orderdate").alias("published_on"), F.col("c_name").alias("author"), F.col("n_name").alias("category"), "total")


@query("""
    SELECT o_orderkey AS article, o_totalprice AS price FROM orders o WHERE o_orderstatus = 'F'
    AND EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = o.o_custkey AND n_name = 'NATION_3')""")
def published_by_category(spark: SparkSession, d: str) -> DataFrame:
    authors = table(spark, d, "customer").join(table(spark, d, "nation").filter("n_name = 'NATION_3'"), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.having(_published(spark, d), authors.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("article"), F.col("o_totalprice").alias("price"))


@query("""
    SELECT o_orderkey AS article FROM orders WHERE o_orderstatus = 'F'
    AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' AND p_brand = 'Brand#7')""")
def published_by_topic(spark: SparkSession, d: str) -> DataFrame:
    topics = R.where_given(table(spark, d, "part"), p_type="PROMO", p_brand="Brand#7")
    bridge = table(spark, d, "lineitem").join(topics, F.col("l_partkey") == F.col("p_partkey"))
    return R.having(_published(spark, d), bridge.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("article"))


@query("""
    SELECT o_orderkey AS article FROM orders WHERE o_orderstatus <> 'O'
    AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R')""")
def placement_same_row(spark: SparkSession, d: str) -> DataFrame:
    """Magazine and section must hold for the same placement."""
    placed = R.where_given(table(spark, d, "lineitem"), l_suppkey=7, l_returnflag="R")
    rows = R.where_given(table(spark, d, "orders"), o_orderstatus=["F", "P"])
    return R.having(rows, placed.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("article"))


@query("""
    SELECT o_orderkey AS article, any_value(c_name) AS author, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type), '') AS topics
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
    WHERE o_orderstatus = 'F' GROUP BY o_orderkey""")
def summary_nested_topics(spark: SparkSession, d: str) -> DataFrame:
    bridge = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_type").distinct()
    rows = _published(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = N.nest(rows, bridge, "o_orderkey", "topics", ["p_type"], ["p_type"])
    return out.select(F.col("o_orderkey").alias("article"), F.col("c_name").alias("author"), N.listed(F.transform("topics", lambda t: t.p_type)).alias("topics"))


@query("""
    SELECT conv_id AS article, count(*) AS blocks, string_agg(turn || ':' || role || ':' || length(text), ',' ORDER BY turn) AS content,
    (SELECT role FROM conversations c WHERE c.conv_id = v.conv_id ORDER BY turn LIMIT 1) AS opens_with
    FROM conversations v GROUP BY conv_id""")
def detail_content(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    parents = rows.select("conv_id").distinct()
    out = N.first_of(N.nest(parents, rows, "conv_id", "content", ["turn"], ["turn", "role", "text"]), rows, "conv_id", "first", ["turn"], ["role"])
    written = F.transform("content", lambda b: F.concat_ws(":", b.turn.cast("string"), b.role, F.length(b.text).cast("string")))
    return out.select(F.col("conv_id").alias("article"), F.size("content").cast("long").alias("blocks"), N.listed(written).alias("content"), F.col("first.role").alias("opens_with"))


@query("""
    WITH v AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS published, max(turn) AS newest FROM conversations GROUP BY conv_id)
    SELECT v.conv_id AS article, published, length(p.text) AS published_chars, CASE WHEN newest > published THEN newest END AS pending,
    CASE WHEN newest > published THEN length(n.text) END AS pending_chars, published IS NOT NULL AS is_published
    FROM v LEFT JOIN conversations p ON p.conv_id = v.conv_id AND p.turn = published LEFT JOIN conversations n ON n.conv_id = v.conv_id AND n.turn = newest""")
def owner_detail_two_versions(spark: SparkSession, d: str) -> DataFrame:
    """An owner sees the published version and the pending one; both roles are left joins to the same table."""
    rows = table(spark, d, "conversations")
    v = rows.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("published"), F.max("turn").alias("newest"))
    side = lambda name: rows.select(F.col("conv_id"), F.col("turn").alias(name), F.length("text").alias(f"{name}_chars"))
    out = v.join(side("published"), ["conv_id", "published"], "left").join(side("newest"), ["conv_id", "newest"], "left")
    pending = F.col("newest") > F.col("published")
    return out.select(F.col("conv_id").alias("article"), "published", F.col("published_chars").cast("long"), F.when(pending, F.col("newest")).alias("pending"), F.when(pending, F.col("newest_chars")).cast("long").alias("pending_chars"), F.col("published").isNotNull().alias("is_published"))


@query("""
    SELECT c_custkey AS user_id, c_name AS name, (SELECT count(*) FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001')) AS total
    FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001') ORDER BY c_name LIMIT 50""")
def user_search(spark: SparkSession, d: str) -> DataFrame:
    found = R.contains_any(table(spark, d, "customer"), ["c_name", "c_mktsegment"], "00001")
    return R.page_of(found, [F.asc("c_name")], limit=50).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "total")


@query("""
    SELECT s_suppkey AS magazine, s_name AS title, count(l_orderkey) AS placements FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey
    WHERE contains(lower(s_name), '00') GROUP BY ALL""")
def magazine_counts(spark: SparkSession, d: str) -> DataFrame:
    magazines = R.contains_any(table(spark, d, "supplier"), ["s_name"], "00")
    out = R.with_count(magazines, table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey", "placements")
    return out.select(F.col("s_suppkey").alias("magazine"), F.col("s_name").alias("title"), "placements")


@query("""
    WITH p AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linenumber, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
    SELECT s_suppkey AS magazine, count(l_orderkey) AS articles,
    coalesce(string_agg(l_returnflag || l_linenumber || '/' || l_orderkey, ' ' ORDER BY l_linenumber, l_orderkey, l_returnflag), '') AS contents
    FROM supplier LEFT JOIN p ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def magazine_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents of each magazine in display order, published articles only."""
    placed = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", "l_linenumber", "l_orderkey")
    placed = R.having(placed, _published(spark, d).select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).distinct()
    out = N.nest(table(spark, d, "supplier"), placed, "s_suppkey", "contents", ["l_linenumber", "l_orderkey", "l_returnflag"], ["l_returnflag", "l_linenumber", "l_orderkey"])
    written = F.transform("contents", lambda x: F.concat(x.l_returnflag, x.l_linenumber.cast("string"), F.lit("/"), x.l_orderkey.cast("string")))
    return out.select(F.col("s_suppkey").alias("magazine"), F.size("contents").cast("long").alias("articles"), N.listed(written, " ").alias("contents"))


@query("""
    SELECT o_orderkey AS article, c_name AS author, strftime(o_orderdate, '%Y-%m-%d') AS submitted_on, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred articles in review, oldest first. Only those are numbered, so the window never sees all rows."""
    rows = R.where_given(table(spark, d, "orders"), o_orderstatus="P").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    first = rows.orderBy("o_orderdate", "o_orderkey").limit(100)
    out = first.withColumn("place", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("long"))
    return out.select(F.col("o_orderkey").alias("article"), F.col("c_name").alias("author"), _day("o_orderdate").alias("submitted_on"), "place")


@query("""
    SELECT conv_id AS article, turn AS version, role AS author, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number,
    count(*) OVER (PARTITION BY conv_id) + 1 AS next_number FROM conversations""")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    out = R.numbered(table(spark, d, "conversations"), ["conv_id"], [F.asc("turn")], "number")
    return out.select(F.col("conv_id").alias("article"), F.col("turn").alias("version"), F.col("role").alias("author"), F.col("number").cast("long"), (F.count(F.lit(1)).over(Window.partitionBy("conv_id")) + 1).alias("next_number"))


@query("SELECT conv_id AS article, turn AS version, role AS author, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    out = R.latest(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    return out.select(F.col("conv_id").alias("article"), F.col("turn").alias("version"), F.col("role").alias("author"), F.length("text").cast("long").alias("chars"))


@query("SELECT s_suppkey AS magazine, coalesce(max(l_linenumber), -1) + 1 AS next_order FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def next_display_order(spark: SparkSession, d: str) -> DataFrame:
    most = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_linenumber").alias("most"))
    return table(spark, d, "supplier").join(most, "s_suppkey", "left").select(F.col("s_suppkey").alias("magazine"), (F.coalesce("most", F.lit(-1)) + 1).alias("next_order"))


@query("""
    SELECT n_nationkey AS category, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS users, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS magazines,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS total FROM nation""")
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    users, magazines = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    out = R.reference_counts(table(spark, d, "nation"), "n_nationkey", users=users, magazines=magazines)
    return out.select(F.col("n_nationkey").alias("category"), "users", "magazines", "total")


@query("""
    SELECT CAST(json_extract_string(props, '$.k') AS INT) AS media, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type NOT IN ('view', 'click')) AS others, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'in use' ELSE 'free' END AS verdict
    FROM events GROUP BY ALL""")
def media_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.variant_get(F.parse_json("props"), "$.k", "int").alias("media"), "event_type")
    of = lambda c: F.count(F.when(c, 1))
    kind = F.col("event_type")
    return rows.groupBy("media").agg(of(kind == "view").alias("views"), of(kind == "click").alias("clicks"), of(~kind.isin("view", "click")).alias("others"), F.when(of(kind == "purchase") > 0, "in use").otherwise("free").alias("verdict"))


@query("""
    SELECT event_id AS comment, CASE WHEN c_acctbal > 0 THEN c_name END AS author FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type <> 'error'""")
def comments_with_author(spark: SparkSession, d: str) -> DataFrame:
    """Comments that aren't deleted; an inactive author isn't named."""
    rows = table(spark, d, "events").filter("event_type <> 'error'").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select(F.col("event_id").alias("comment"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("author"))


@query("""
    SELECT 'DUPLICATE' AS code, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS rows
    UNION ALL SELECT 'NO_PARENT', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'))""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    parents = R.where_given(table(spark, d, "orders"), o_orderstatus=["F", "P"]).select(F.col("o_orderkey").alias("l_orderkey"))
    return R.violations(table(spark, d, "lineitem"), parents, ["l_orderkey", "l_linenumber"], "l_orderkey")


@query("""
    WITH old AS (SELECT l_suppkey AS magazine, l_orderkey AS article, max(l_linenumber) AS place FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    new AS (SELECT l_suppkey AS magazine, l_orderkey AS article, min(l_linenumber) + 100 AS place FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT coalesce(new.magazine, old.magazine) AS magazine, coalesce(new.article, old.article) AS article, coalesce(new.place, old.place) AS place
    FROM old FULL JOIN new ON old.magazine = new.magazine AND old.article = new.article""")
def upsert_placement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("magazine"), F.col("l_orderkey").alias("article"), "l_linenumber", "l_returnflag")
    old = rows.filter("l_returnflag = 'A'").groupBy("magazine", "article").agg(F.max("l_linenumber").alias("place"))
    new = rows.filter("l_returnflag = 'R'").groupBy("magazine", "article").agg((F.min("l_linenumber") + 100).alias("place"))
    return R.upsert(old, new, ["magazine", "article"])


@query("""
    WITH p AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN [] ELSE [role, 'x'] END AS items FROM conversations WHERE turn = 0)
    SELECT conv_id, CAST(turn + 1 AS INT) AS position, role AS value FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM p WHERE items IS NOT NULL)
    UNION ALL SELECT conv_id, CAST(i AS INT), items[i] FROM p, unnest(range(1, len(items) + 1)) AS t(i)""")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    kind = F.col("conv_id") % 3
    payload = rows.filter("turn = 0").select("conv_id", F.when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array("role", F.lit("x"))).alias("items"))
    old = rows.select("conv_id", (F.col("turn") + 1).cast("int").alias("position"), F.col("role").alias("value"))
    return R.replace_children(old, payload, "conv_id", "items")


def _fields() -> dict:
    return {"title": (T.first_line(F.col("text")), "A"), "source": (F.col("source"), "C"), "body": (F.col("text"), "D")}


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return R.having(table(spark, d, "documents"), good, ["doc_id"])


_WORDS_SQL = """
    WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z]+') AS a, regexp_extract_all(lower(coalesce(source, '')), '[a-z]+') AS c,
    regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS b FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    m AS (SELECT * FROM w WHERE (list_contains(a, 'thon') OR list_contains(b, 'thon') OR list_contains(c, 'thon') OR list_contains(a, 'thth') OR list_contains(b, 'thth') OR list_contains(c, 'thth'))
    AND (contains(' ' || array_to_string(a, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(b, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(c, ' ') || ' ', ' of the '))
    AND NOT (list_contains(a, 'worthless') OR list_contains(b, 'worthless') OR list_contains(c, 'worthless'))),
    s AS (SELECT doc_id, text, b, CAST(list_sum([10 * least(len(list_filter(a, lambda x: x = t)), 3) + 2 * least(len(list_filter(c, lambda x: x = t)), 3) + least(len(list_filter(b, lambda x: x = t)), 3)
    FOR t IN ['thon', 'thth', 'of', 'the']]) AS BIGINT) AS score FROM m)
"""


@query(_WORDS_SQL + "SELECT doc_id FROM s")
def search_match(spark: SparkSession, d: str) -> DataFrame:
    fields = _fields()
    return S.matching(S.indexed(_searchable(spark, d), fields), fields, S.parse(SEARCH)).select("doc_id")


@query(_WORDS_SQL + "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 published documents: a top-k report."""
    return S.ranked(_searchable(spark, d), _fields(), SEARCH, "doc_id").select("doc_id", "score")


@query(_WORDS_SQL + """
    , t AS (SELECT doc_id, score FROM s JOIN documents USING (doc_id) WHERE lang = 'en' AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10) ORDER BY score DESC, doc_id LIMIT 20)
    SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id, score, source, length(d.text) AS chars FROM t JOIN documents d USING (doc_id)""")
def search_hydrated(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 in one language and in sources that ten documents have, with their rows, in the order of their ranks: a top-k report."""
    docs = table(spark, d, "documents")
    large = docs.groupBy("source").count().filter("count >= 10").select("source")
    found = S.ranked(R.having(R.where_given(_searchable(spark, d), lang="en"), large, ["source"]), _fields(), SEARCH, "doc_id")
    return S.hydrated(found, docs, "doc_id").select("place", "doc_id", "score", "source", F.length("text").cast("long").alias("chars"))


@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
    h AS (SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g') IN ('thon', 'thth', 'of', 'the')) AS hit FROM w),
    p AS (SELECT doc_id, w, hit, greatest(1, coalesce(list_position(hit, true), 0) - 8) AS s FROM h)
    SELECT doc_id, coalesce(array_to_string([CASE WHEN hit[i] THEN '<b>' || w[i] || '</b>' ELSE w[i] END FOR i IN range(s, least(s + 40, len(w) + 1))], ' '), '') AS snippet FROM p""")
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.snippet(F.col("text"), S.parse(SEARCH)).alias("snippet"))


@query("""
    SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS words, CAST(greatest(1, ceil(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) / 200.0)) AS BIGINT) AS minutes FROM documents""")
def reading_minutes(spark: SparkSession, d: str) -> DataFrame:
    words = T.word_count(F.col("text"))
    return table(spark, d, "documents").select("doc_id", words.alias("words"), B.reading_minutes(words).alias("minutes"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """An issue is a source's documents of 200 ids in a row."""
    issue = F.concat_ws("/", "source", F.expr("doc_id div 200"))
    return table(spark, d, "documents").select(issue.alias("issue"), "doc_id", "text")


_KEY_SQL = "lower(trim(regexp_replace({}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')))"
_FURNITURE_SQL = f"""
    WITH d AS (SELECT concat_ws('/', source, doc_id // 200) AS issue, doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS r FROM documents),
    l AS (SELECT issue, doc_id, list_filter(r, lambda x: {_KEY_SQL.format("x")} <> '') AS l FROM d),
    e AS (SELECT issue, doc_id, unnest(list_concat(l[1:3], l[greatest(1, len(l) - 2):])) AS x FROM l WHERE len(l) > 0),
    k AS (SELECT DISTINCT issue, doc_id, {_KEY_SQL.format("x")} AS line FROM e),
    n AS (SELECT issue, count(*) AS n FROM d GROUP BY issue),
    f AS (SELECT issue, line, count(*) AS pages FROM k JOIN n USING (issue) WHERE length(line) >= 4 GROUP BY issue, line, n HAVING count(*) >= greatest(3, ceil(n / 4)))
"""


@query(_FURNITURE_SQL + "SELECT issue, line, pages FROM f")
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines at the edges of a quarter of an issue's pages, three at least."""
    return P.furniture(_pages(spark, d), "issue", "doc_id", "text")


@query(_FURNITURE_SQL + f""", g AS (SELECT issue, list(line) AS known FROM f GROUP BY issue),
    x AS (SELECT d.issue, doc_id, r, coalesce(known, []) AS known FROM d LEFT JOIN g ON d.issue = g.issue)
    SELECT issue, doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(array_to_string([r[i] FOR i IN range(1, len(r) + 1) IF NOT ((i <= 3 OR i > len(r) - 3)
    AND (regexp_matches(r[i], '^[\\s\\x0B\\p{{Z}}]*[0-9]{{1,3}}[\\s\\x0B\\p{{Z}}]*$') OR list_contains(known, {_KEY_SQL.format("r[i]")})))], chr(10)), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'),
    '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g')) AS text_sha256 FROM x""")
def furniture_stripped(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    out = P.strip_furniture(pages, P.furniture(pages, "issue", "doc_id", "text"), "issue", "doc_id", "text")
    return out.select("issue", "doc_id", F.sha2(T.dehyphenate(F.col("text")), 256).alias("text_sha256"))


@query("""
    WITH c AS (SELECT source, lang, count(*) AS times, min(doc_id) AS first FROM documents GROUP BY ALL)
    SELECT source, lang, times, round(times / (SELECT sum(times) FROM c x WHERE x.source IS NOT DISTINCT FROM c.source), 4) AS agreement
    FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY times DESC, first) = 1""")
def mode_with_agreement(spark: SparkSession, d: str) -> DataFrame:
    return P.most_frequent(table(spark, d, "documents"), "source", "lang", "doc_id")


@query("""
    WITH s AS (SELECT conv_id, turn AS start_page, max(turn) OVER (PARTITION BY conv_id) + 3 AS pages FROM conversations WHERE role <> 'assistant')
    SELECT conv_id, start_page, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY conv_id ORDER BY start_page) - 1, pages)) AS end_page FROM s""")
def ranges_from_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("role <> 'assistant'").select("conv_id", F.col("turn").alias("start_page"), (F.max("turn").over(Window.partitionBy("conv_id")) + 3).alias("pages"))
    return P.ranges_from_starts(rows, "conv_id", "start_page", "pages").select("conv_id", "start_page", "end_page")


def _hits(text: str, words: list[str], times: str) -> str:
    return " + ".join(times.format(f"CAST((length({text}) - length(replace({text}, '{w}', ''))) // {len(w)} AS BIGINT)") for w in words)


def _keywords_sql() -> str:
    columns = ", ".join(f"({_hits('t', words, '12 * {}')} + {_hits('b', words, 'least({}, 3)')}) AS s{k}" for k, words in enumerate(KEYWORDS.values()))
    names = list(KEYWORDS)
    return f"""
    WITH x AS (SELECT doc_id, lower(split_part(coalesce(text, ''), chr(10), 1)) AS t, lower(left(coalesce(text, ''), 4000)) AS b FROM documents), s AS (SELECT doc_id, {columns} FROM x),
    o AS (SELECT *, list_reverse_sort([s0, s1, s2]) AS o FROM s)
    SELECT doc_id, CASE WHEN o[1] = 0 THEN 'other' WHEN s0 = o[1] THEN '{names[0]}' WHEN s1 = o[1] THEN '{names[1]}' ELSE '{names[2]}' END AS category, o[1] AS score,
    o[1] >= 12 AND o[1] >= o[2] + 2 AS confident FROM o"""


@query(_keywords_sql())
def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return P.classify(docs, T.first_line(F.col("text")), F.col("text"), KEYWORDS, "other").select("doc_id", "category", "score", "confident")


@query("""
    WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t,
    list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(split_part(text, chr(10), 2))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS u FROM documents)
    SELECT doc_id, CASE WHEN least(len(t), len(u)) > 0 THEN round(len(list_intersect(t, u)) / least(len(t), len(u)), 6) ELSE 0.0 END AS shared FROM d""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words that a document's first two lines share."""
    line = lambda n: F.split_part("text", F.lit("\n"), F.lit(n))
    return table(spark, d, "documents").select("doc_id", F.round(T.overlap(line(1), line(2)), 6).alias("shared"))


@query("""
    WITH r AS (SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(replace(lower(strip_accents(p_name)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-'), 200), ''), 'item') AS root FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS n FROM r)
    SELECT p_partkey, CASE WHEN n = 1 THEN root ELSE root || '-' || n END AS slug FROM n""")
def slug_unique(spark: SparkSession, d: str) -> DataFrame:
    """No part's plain slug ends in a number, so the SQL has no case for it; tests/test_rules.py has."""
    return P.unique_slugs(table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("""
    SELECT c_custkey, (SELECT min(x.n_nationkey) FROM nation x WHERE regexp_replace(replace(lower(x.n_name), '&', 'and'), '[^a-z0-9]+', '', 'g') =
    regexp_replace(replace(lower(CASE c_custkey % 3 WHEN 0 THEN '  ' || replace(n.n_name, '_', ' - ') || '. ' WHEN 1 THEN upper(n.n_name) ELSE 'no ' || n.n_name END), '&', 'and'), '[^a-z0-9]+', '', 'g')) AS n_nationkey
    FROM customer JOIN nation n ON c_nationkey = n.n_nationkey""")
def normalised_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations as someone typed them, resolved to the nations."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    name, of = F.col("n_name"), F.col("c_custkey") % 3
    typed = F.when(of == 0, F.concat(F.lit("  "), F.replace(name, F.lit("_"), F.lit(" - ")), F.lit(". "))).when(of == 1, F.upper(name)).otherwise(F.concat(F.lit("no "), name))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", typed.alias("typed"))
    return P.match_names(rows, "typed", nations, "n_name", "n_nationkey").select("c_custkey", "n_nationkey")


@query("""
    WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN role END AS label FROM conversations),
    b AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
    SELECT conv_id, turn, label FROM b WHERE label IS NOT NULL AND label IS DISTINCT FROM before""")
def section_changes(spark: SparkSession, d: str) -> DataFrame:
    """Roles stand for section labels; every fourth turn has none."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.col("role")).alias("label"))
    return P.section_changes(rows, "conv_id", "turn", "label")


_TIDY_SQL = "nullif(trim(regexp_replace({}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')), '')"


@query(f"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: coalesce({_TIDY_SQL.format("x")}, '')),
    lambda x: length(x) > 60 AND regexp_matches(x, '^[A-Z"''(]') AND regexp_matches(x, '[a-z]{{4}}')) AS l FROM documents),
    j AS (SELECT doc_id, coalesce(array_to_string(l[1:4], ' '), '') AS j FROM l),
    h AS (SELECT doc_id, j, left(j, 420) AS h, strpos(reverse(left(j, 420)), ' .') AS i FROM j),
    s AS (SELECT doc_id, j, CASE WHEN i > 0 AND length(h) - i - 1 > 140 THEN left(h, length(h) - i) ELSE trim(h) || '…' END AS s FROM h)
    SELECT doc_id, CASE WHEN length(j) >= 120 AND len(regexp_extract_all(s, '[A-Za-z]')) * 10 >= length(s) * 7 THEN trim(s) END AS summary FROM s""")
def standfirst(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.standfirst(F.col("text")).alias("summary"))


@query("""
    WITH k AS (SELECT conv_id, turn, role = 'assistant' AS s FROM conversations), c AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM c)
    SELECT conv_id, island, any_value(s) AS is_list, min(turn) AS first, max(turn) AS last, count(*) AS size FROM i GROUP BY conv_id, island""")
def list_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("s"))
    return P.islands(rows, "conv_id", "turn", "s").withColumnRenamed("value", "is_list")


@query("SELECT doc_id FROM (SELECT doc_id, text = lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS again FROM documents) WHERE again")
def adjacent_duplicates(spark: SparkSession, d: str) -> DataFrame:
    again = F.col("text") == F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").withColumn("again", again).filter("again").select("doc_id")


@query("""
    WITH b AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
    p AS (SELECT item_id, array_to_string(w[1:9], ' ') AS p FROM b WHERE len(w) >= 9),
    d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)
    SELECT doc_id, item_id, CAST(len(string_split(left(t, strpos(t, ' ' || p || ' ')), ' ')) - 2 AS BIGINT) AS position FROM d, p WHERE contains(t, ' ' || p || ' ')""")
def anchor_passages(spark: SparkSession, d: str) -> DataFrame:
    return P.anchors(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""
    WITH w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
    n AS (SELECT *, CASE WHEN coalesce(length(b) >= 40 AND NOT regexp_matches(rtrim(b), '[.!?:"”)]$') AND regexp_matches(text, '^\\p{Ll}'), false) THEN 0 ELSE 1 END AS new FROM w),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
    SELECT conv_id, min(turn) AS first, count(*) AS parts, sum(length(text)) + count(*) - 1 AS chars FROM r GROUP BY conv_id, run""")
def continuations(spark: SparkSession, d: str) -> DataFrame:
    out = P.join_continuations(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "first", F.col("parts").cast("long"), F.length("text").cast("long").alias("chars"))


@query("""
    WITH RECURSIVE e AS (SELECT conv_id AS issue, CASE WHEN turn % 5 <> 2 AND turn + conv_id % 3 > 1 THEN CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END END AS title, (turn - (turn % 7 = 3)::INT) * (4 + 40 * (conv_id % 9 = 0)::INT) + 1 AS s, (turn + 1) * (4 + 40 * (conv_id % 9 = 0)::INT) + 3 * (turn % 4 = 1)::INT AS f FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY s, f, title NULLS FIRST) AS k FROM e),
    z AS (SELECT issue, coalesce(min(k) FILTER (WHERE title IS NOT NULL), max(k)) AS z, max(k) AS n FROM k GROUP BY issue),
    w AS (SELECT k.issue, k.k, k.title, (SELECT min(s) FROM k b WHERE b.issue = k.issue AND b.k <= k.k) AS s, k.k AS g FROM k JOIN z ON k.issue = z.issue AND k.k = z.z
    UNION ALL SELECT k.issue, k.k, CASE WHEN c.stray THEN w.title ELSE k.title END, CASE WHEN c.stray THEN w.s ELSE k.s END, CASE WHEN c.stray THEN w.g ELSE k.k END
      FROM w JOIN k ON k.issue = w.issue AND k.k = w.k + 1, LATERAL (SELECT k.title IS NULL OR coalesce(lower(k.title) = lower(w.title), false) OR k.s <= w.s AS stray) c),
    g AS (SELECT w.issue, w.g, any_value(w.title) AS title, any_value(w.s) AS start_page, max(k.f) AS end_page, count(*) + CASE WHEN w.g = any_value(z.z) THEN any_value(z.z) - 1 ELSE 0 END AS merged FROM w JOIN k USING (issue, k) JOIN z USING (issue) GROUP BY w.issue, w.g)
    SELECT issue, title, start_page, end_page, merged, CASE WHEN end_page - start_page + 1 > 40 THEN CASE WHEN g = max(g) OVER (PARTITION BY issue) THEN 'back matter' ELSE 'entry lost' END END AS long FROM g""")
def orphan_merge(spark: SparkSession, d: str) -> DataFrame:
    """Turns stand for entries of a contents table. Titles are roles, in capitals on even turns; some are lost, some entries begin on a page that another has, and some issues have long articles."""
    t, wide = F.col("turn").cast("long"), 4 + F.when(F.col("conv_id") % 9 == 0, 40).otherwise(0)
    title = F.when((t % 5 != 2) & (t + F.col("conv_id") % 3 > 1), F.when(t % 2 == 0, F.upper("role")).otherwise(F.col("role")))
    start = (t - F.when(t % 7 == 3, 1).otherwise(0)) * wide + 1
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("issue"), title.alias("title"), start.alias("start_page"), ((t + 1) * wide + F.when(t % 4 == 1, 3).otherwise(0)).alias("end_page"))
    return P.merge_orphans(rows)


@query("""
    WITH w AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word),
    pairs AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM w, unnest(range(1, len(w))) AS t(i)), f AS (SELECT word FROM c WHERE n >= 5 AND length(word) >= 3),
    k AS (SELECT word, i AS cut, left(word, i) AS a, substr(word, i + 1) AS b FROM c, unnest(range(3, length(word) - 2)) AS t(i) WHERE n < 5 AND length(word) >= 8),
    g AS (SELECT k.* FROM k SEMI JOIN pairs ON k.a = pairs.a AND k.b = pairs.b WHERE k.a IN (SELECT word FROM f) AND k.b IN (SELECT word FROM f))
    SELECT word, arg_min(a, cut) AS left, arg_min(b, cut) AS right FROM g GROUP BY word""")
def glued_words(spark: SparkSession, d: str) -> DataFrame:
    return P.glued_words(table(spark, d, "documents"), "doc_id", "text")


def _as_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns stand for blocks: two of each of the ten types and of an unknown one in a row, right and wrong ones."""
    t, x, role = F.col("turn"), F.coalesce("text", F.lit("")), F.col("role")
    kinds = F.array(*(F.lit(k) for k in [*B.BLOCK_TYPES, "video"]))
    media = F.when(t % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("conv_id").cast("string"), 12, "0")))
    every = lambda n, wrong, right: F.when(t % n == 0, wrong).otherwise(right)
    rows = F.when(t % 7 == 0, F.array().cast("array<array<string>>")).when(t % 5 == 0, F.array(F.array(x))).otherwise(F.array(F.array(x, role), F.array(role, role)))
    content = {
        "heading": {"text": x, "level": t % 9}, "paragraph": {"text": x}, "image": {"mediaId": media, "caption": x, "altText": x}, "quote": {"text": x, "attribution": x},
        "callout": {"title": x, "text": every(2, F.lit(" "), x)}, "table": {"caption": x, "columns": F.array(role, every(4, F.lit(" "), F.lit("b"))), "rows": rows},
        "figure": {"mediaId": media, "caption": x, "source": x}, "list": {"style": F.get(F.array(*(F.lit(k) for k in ("ordered", "roman", "letter", "bullets"))), (t % 4).cast("int")), "items": F.when(t % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(x, every(3, F.lit(" "), role)))},
        "formula": {"expression": every(3, F.lit(""), x), "note": x}, "reference": {"items": F.array(F.struct(every(4, F.lit(" "), x).alias("label"), every(3, F.lit("no url"), F.lit("https://a.example/b")).alias("url")))}, "video": {"text": x},
    }
    kind = F.get(kinds, F.expr("((conv_id + turn) div 2) % 11").cast("int"))
    blocks = table(spark, d, "conversations").select("conv_id", t.alias("position"), kind.alias("block_type"), "text", "role", "turn")
    written = F.coalesce(*(F.when(F.col("block_type") == k, F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))) for k, fields in content.items()))
    return blocks.select("conv_id", "position", "block_type", written.alias("content"))


_BLOCKS_SQL = """
    WITH b AS (SELECT conv_id, turn AS t, ((conv_id + turn) // 2) % 11 AS k, coalesce(text, '') AS x, role, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS w,
    regexp_matches(coalesce(text, ''), '^[\\s\\x0B\\p{Z}]*$') AS blank, length(regexp_replace(coalesce(text, ''), '^[\\s\\x0B\\p{Z}]+|[\\s\\x0B\\p{Z}]+$', '', 'g')) AS n FROM conversations)
"""


@query(_BLOCKS_SQL + """
    SELECT conv_id, t AS position, array_to_string(list_filter([
    CASE WHEN k = 10 THEN 'type: unknown' END, CASE WHEN k IN (0, 1, 3) AND blank OR k = 4 AND (blank OR t % 2 = 0) THEN 'text: required' END,
    CASE WHEN k = 0 AND t % 9 NOT BETWEEN 1 AND 6 THEN 'level: out of range' END, CASE WHEN k IN (2, 6) AND t % 3 = 0 THEN 'mediaId: not a uuid' END,
    CASE WHEN k = 8 AND (blank OR t % 3 = 0) THEN 'expression: required' END, CASE WHEN k = 7 AND t % 4 = 3 THEN 'style: unknown' END, CASE WHEN k = 7 AND t % 5 = 0 THEN 'items: required' END,
    CASE WHEN k = 7 AND t % 5 <> 0 AND (blank OR t % 3 = 0) THEN 'items: blank' END, CASE WHEN k = 9 AND (blank OR t % 4 = 0) THEN 'items.label: required' END, CASE WHEN k = 9 AND t % 3 = 0 THEN 'items.url: not a URL' END,
    CASE WHEN k = 5 AND t % 4 = 0 THEN 'columns: blank' END, CASE WHEN k = 5 AND t % 7 = 0 THEN 'rows: required' END, CASE WHEN k = 5 AND t % 7 <> 0 AND t % 5 = 0 THEN 'rows: another width' END,
    CASE WHEN k = 2 AND n > 500 THEN 'caption: too long' END, CASE WHEN k = 2 AND n > 300 THEN 'altText: too long' END, CASE WHEN k = 3 AND n > 200 THEN 'attribution: too long' END, CASE WHEN k = 4 AND n > 200 THEN 'title: too long' END,
    CASE WHEN k = 5 AND n > 300 THEN 'caption: too long' END, CASE WHEN k = 6 AND n > 500 THEN 'caption: too long' END, CASE WHEN k = 6 AND n > 300 THEN 'source: too long' END, CASE WHEN k = 8 AND n > 300 THEN 'note: too long' END
    ], lambda e: e IS NOT NULL), ';') AS errors FROM b""")
def block_validation(spark: SparkSession, d: str) -> DataFrame:
    return _as_blocks(spark, d).select("conv_id", "position", F.array_join(B.block_errors(), ";").alias("errors"))


@query("""
    WITH b AS (SELECT conv_id, turn, turn % 4 AS k, CASE WHEN conv_id % 2 = 0 THEN 'same words' ELSE text END AS p, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM conversations WHERE conv_id % 10 <> 7),
    s AS (SELECT conv_id, count(*) AS blocks, sum(CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 + w ELSE CASE WHEN conv_id % 2 = 0 THEN 2 ELSE w END END)::BIGINT AS words, bool_or(again) AS again
    FROM (SELECT *, coalesce(k IN (0, 3) AND lag(k) OVER o IN (0, 3) AND p = lag(p) OVER o, false) AS again FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id)
    SELECT d.conv_id, coalesce(blocks, 0) AS blocks, coalesce(words, 0) AS words, array_to_string(list_filter([CASE WHEN blocks IS NULL THEN 'no blocks' WHEN words < 60 THEN 'few words' END, CASE WHEN d.conv_id % 4 = 0 THEN 'no category' END, CASE WHEN d.conv_id % 3 < 2 THEN 'no summary' END,
    CASE WHEN d.conv_id % 5 = 0 THEN 'no byline' END, CASE WHEN again THEN 'repeated paragraph' END], lambda e: e IS NOT NULL), ';') AS warnings FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN s USING (conv_id)""")
def quality_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Turns are blocks: formulas whose note is no prose, lists with an item that is no text, and paragraphs; one document in ten has none."""
    rows, n, k = table(spark, d, "conversations"), F.col("conv_id"), F.col("turn") % 4
    docs = rows.select("conv_id").distinct().withColumns({"category": F.when(n % 4 > 0, n), "summary": F.when(n % 3 == 0, "").when(n % 3 == 2, "s"), "author": F.when(n % 5 == 0, "The Review").otherwise("Ada Moe")})
    formula = F.to_json(F.struct(F.col("role").alias("expression"), F.col("text").alias("note")))
    items = F.to_json(F.array("role", "text"))
    listed = F.concat(F.lit('{"items":'), F.substring(items, F.lit(1), F.length(items) - 1), F.lit(',{"label":"a b"}]}'))
    said = F.to_json(F.struct(F.when(n % 2 == 0, "same words").otherwise(F.col("text")).alias("text")))
    kind = F.when(k == 1, "formula").when(k == 2, "list").otherwise("paragraph")
    blocks = rows.filter("conv_id % 10 <> 7").select("conv_id", F.col("turn").alias("position"), kind.alias("block_type"), F.when(k == 1, formula).when(k == 2, listed).otherwise(said).alias("content"))
    return B.quality_warnings(docs, blocks, "conv_id", "The Review").select("conv_id", "blocks", "words", F.array_join("warnings", ";").alias("warnings"))


@query()
def html_to_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.html_to_blocks(table(spark, d, "pages"))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("guest"), F.get_json_object("props", "$.k").cast("int").alias("article"), F.col("ts").alias("at"))


@query("""
    WITH f AS (SELECT user_id AS guest, CAST(json_extract_string(props, '$.k') AS INT) AS article, min(ts) AS t FROM events GROUP BY ALL)
    SELECT guest, article, row_number() OVER (PARTITION BY guest ORDER BY t, article) <= 5 AS allowed FROM f""")
def guest_quota(spark: SparkSession, d: str) -> DataFrame:
    return Z.quota(_reads(spark, d), 5).select("guest", "article", "allowed")


def _outbox(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "SENT").otherwise("PENDING")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.col("ts").alias("created"))


@query("""
    SELECT event_id AS id, CAST(event_id % 4 AS INT) + 1 AS attempts FROM events WHERE event_type <> 'purchase' AND event_id % 4 < 3 ORDER BY ts, event_id LIMIT 20""")
def outbox_claim(spark: SparkSession, d: str) -> DataFrame:
    """A batch of 20 is what a claim is."""
    return Z.claim(_outbox(spark, d)).select("id", "attempts")


@query("""
    WITH c AS (SELECT event_id AS id, user_id, CAST(event_id % 4 AS INT) + 1 AS attempts FROM events WHERE event_type <> 'purchase' AND event_id % 4 < 3 ORDER BY ts, event_id LIMIT 20)
    SELECT id, attempts, CASE WHEN user_id % 5 = 0 THEN 'FAILED' WHEN id % 3 <> 0 THEN 'SENT' WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status,
    CASE WHEN user_id % 5 = 0 THEN 'no notification' WHEN id % 3 = 0 THEN 'bounced' END AS error FROM c""")
def outbox_drain(spark: SparkSession, d: str) -> DataFrame:
    out = Z.drained(Z.claim(_outbox(spark, d)), F.col("id") % 3 != 0, F.lit("bounced"), F.col("user_id") % 5 != 0)
    return out.select("id", "attempts", "status", "error")


@query("""
    SELECT o_orderkey AS article, c_custkey AS user_id FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus = 'F')), customer WHERE c_acctbal > 0 AND c_custkey <> o_custkey""")
def fanout(spark: SparkSession, d: str) -> DataFrame:
    """Mail for all publications of the newest day: those of one run."""
    rows = _published(spark, d).withColumn("day", F.to_date("o_orderdate"))
    new = rows.join(rows.agg(F.max("day").alias("day")), "day").select(F.col("o_orderkey").alias("article"), F.col("o_custkey").alias("author"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("active"), (F.col("c_acctbal") > 0).alias("wants_mail"))
    return Z.fan_out(new, users)


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
    w(user_id, s) AS (SELECT user_id, min(t) FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(e.t) FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.s + 86400000000 GROUP BY e.user_id)
    SELECT e.event_id AS id, row_number() OVER (PARTITION BY e.user_id, w.s ORDER BY e.t, e.event_id) <= 3 AS allowed FROM e JOIN w ON e.user_id = w.user_id AND e.t >= w.s AND e.t < w.s + 86400000000""")
def fixed_window_limiter(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return Z.limited(hits, 24 * HOUR_US, 3).select("id", "allowed")


@query()
def workflow_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation is a command to its article, in this cycle."""
    cycle = F.array(*(F.lit(c) for c in ("create", "submit", "approve", "revise", "submit", "reject", "submit", "unpublish")))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("article"), F.col("turn").cast("long").alias("seq"), F.get(cycle, ((F.col("turn") + F.col("conv_id") % 5 * F.when(F.col("turn") > 3, 1).otherwise(0)) % 8).cast("int")).alias("command"))
    return W.fold(rows)


@query("""
    SELECT o_orderstatus AS status, l_returnflag AS section, count(*) AS placements, count(DISTINCT o_orderkey) AS articles
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderstatus, l_returnflag)""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.rollup(F.col("o_orderstatus").alias("status"), F.col("l_returnflag").alias("section")).agg(F.count(F.lit(1)).alias("placements"), F.countDistinct("o_orderkey").alias("articles"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ledger_pending(spark: SparkSession, d: str) -> DataFrame:
    return P.pending(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("""
    SELECT doc_id, CAST(s AS BIGINT) AS chunk_start, CAST(least(s + 5, 1 + n_chars // 500) AS BIGINT) AS chunk_end FROM documents, unnest(range(1, 2 + n_chars // 500, 6)) AS t(s)""")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("start"), (1 + F.expr("n_chars div 500")).alias("end"))
    return P.chunks(rows, "start", "end").select("doc_id", "chunk_start", "chunk_end")


@query("""
    WITH k AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(length(text) AS DOUBLE) END AS p FROM conversations),
    j AS (SELECT k.*, max(CASE WHEN p IS NOT NULL THEN turn END) OVER b AS bt, min(CASE WHEN p IS NOT NULL THEN turn END) OVER a AS at FROM k
    WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT j.conv_id, j.turn, round(coalesce(j.p, b.p + (a.p - b.p) * (j.turn - j.bt) / (j.at - j.bt), b.p, a.p), 6) AS position
    FROM j LEFT JOIN k b ON b.conv_id = j.conv_id AND b.turn = j.bt LEFT JOIN k a ON a.conv_id = j.conv_id AND a.turn = j.at""")
def interpolated_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text")).alias("position"))
    return P.interpolated(rows, "conv_id", "turn", "position").select("conv_id", "turn", F.round("position", 6).alias("position"))
