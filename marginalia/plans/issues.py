"""Named queries of titles, bylines, openings and blocks of issues, each beside its SQL. Which table stands for what is in ``plans.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import issues as I  # noqa: E741
from marginalia.plans.registry import query
from marginalia.sources.tables import table

ACRONYMS = ("gdp", "ups", "r&d")
_TRIM = "regexp_replace({}, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')"
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_SHORTS = ", ".join(f"regexp_matches(t, '{x}', 'i')" for x in I.FURNITURE)


@query(f"""
    WITH d AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents),
    t AS (SELECT doc_id, {_TRIM.format('''CASE doc_id % 8 WHEN 0 THEN line WHEN 1 THEN line[1:40] WHEN 2 THEN regexp_replace(line[1:20], '(.)', '\\1\\1', 'g') WHEN 3 THEN line[1:30] || ' Cover Story rest'
    WHEN 4 THEN 'Table ' || line[1:30] WHEN 5 THEN line[1:60] || ' and' WHEN 6 THEN line[1:50] || ' 12 a b c d e' ELSE 'An' || replace(line[1:9], ' ', '') || 'Bx cde' END''')} AS t FROM d),
    w AS (SELECT *, regexp_split_to_array(t, '\\s+') AS w, lower(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l FROM t)
    SELECT doc_id, length(t) < 8 OR list_bool_or([{_SHORTS}]) OR regexp_matches(t, '^[a-z]') OR regexp_matches(t, '\\b({I.DANGLING})$', 'i') OR length(t) > 140 OR len(w) > 22
    OR (length(l) >= 10 AND 5 * len(list_filter(range(2, length(l) + 1), lambda i: l[i] = l[i - 1])) > 2 * length(l))
    OR len(list_filter(w, lambda x: length(x) > 16 OR (length(x) > 10 AND regexp_matches(x, '[a-z][A-Z]')))) > 0
    OR (len(w) >= 8 AND len(list_filter(w[2:], lambda x: regexp_matches(x, '^[0-9]{{2,3}}$'))) > 0) OR regexp_matches(t, '{I.INNER_STRAPS}', 'i') AS garbled FROM w""")
def garbled_titles(spark: SparkSession, d: str) -> DataFrame:
    line, n = T.first_line(F.col("text")), F.col("doc_id") % 8
    head = lambda k: F.substring(line, 1, k)
    title = (
        F.when(n == 0, line).when(n == 1, head(40)).when(n == 2, F.regexp_replace(head(20), "(.)", "$1$1")).when(n == 3, F.concat(head(30), F.lit(" Cover Story rest")))
        .when(n == 4, F.concat(F.lit("Table "), head(30))).when(n == 5, F.concat(head(60), F.lit(" and"))).when(n == 6, F.concat(head(50), F.lit(" 12 a b c d e")))
        .otherwise(F.concat(F.lit("An"), F.replace(head(9), F.lit(" "), F.lit("")), F.lit("Bx cde")))
    )
    return table(spark, d, "documents").select("doc_id", I.garbled(title).alias("garbled"))


@query(f"""
    WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(p_name || ' of the ' || p_brand || '/gdp-(ups) ' || p_type) WHEN 1 THEN upper('the ' || p_name || ' - r&d for ' || p_type || ' in') WHEN 2 THEN p_name || ' OF ' || p_type ELSE ' ' || p_brand || '-' END AS t FROM part),
    c AS (SELECT p_partkey, trim(t) AS t, regexp_extract_all(lower(trim(t)), '[\\s–—/-]|[^\\s–—/-]+') AS w, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up FROM t),
    b AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '[^a-z0-9&]', '', 'g')) AS b, list_transform(w, lambda x: length(regexp_extract(x, '^[^a-z]*'))) AS p FROM c)
    SELECT p_partkey AS title_id, CASE WHEN up = 0 OR 5 * low > low + up THEN t ELSE array_to_string([CASE WHEN NOT regexp_matches(w[i], '[a-z]') THEN w[i] WHEN b[i] IN ({_QUOTED(ACRONYMS)}) THEN replace(w[i], b[i], upper(b[i]))
    WHEN i > 1 AND i < len(w) AND b[i] IN ({_QUOTED(I.SMALL_WORDS)}) THEN w[i] ELSE substr(w[i], 1, p[i]) || upper(substr(w[i], p[i] + 1, 1)) || substr(w[i], p[i] + 2) END FOR i IN range(1, len(w) + 1)], '') END AS title FROM b""")
def headline_case(spark: SparkSession, d: str) -> DataFrame:
    n, name, brand, kind = F.col("p_size") % 4, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    title = (
        F.when(n == 0, F.upper(F.concat(name, F.lit(" of the "), brand, F.lit("/gdp-(ups) "), kind)))
        .when(n == 1, F.upper(F.concat(F.lit("the "), name, F.lit(" - r&d for "), kind, F.lit(" in"))))
        .when(n == 2, F.concat(name, F.lit(" OF "), kind))
        .otherwise(F.concat(F.lit(" "), brand, F.lit("-")))
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("title_id"), I.title_case(title, ACRONYMS).alias("title"))


_LINES = ("By Tobin Marsh, Keeper of a Mill. Retired", "-Mr Lionel K Ferro", "THE WHOLE STORY", "Anil Kumar,  Director", "Who Is Anil Kumar?", "Power for Anil", "Prof. Jo Van Der Berg.", "a small line", "", "Anil")
_LINE_SQL = f"([{_QUOTED(_LINES)}][1 + s_suppkey % 10] || CASE WHEN s_nationkey % 3 = 0 THEN ' ' || s_name ELSE '' END)"
_NAME_SQL = f"trim(regexp_replace(regexp_split_to_array(regexp_replace(x, '{I.BYLINE_PREFIX}', '', 'i'), '\\s*[,.]\\s+')[1], '[.,;:]+$', ''))"


@query(f"""
    WITH x AS (SELECT s_suppkey, trim(regexp_replace({_LINE_SQL}, '\\s+', ' ', 'g')) AS x FROM supplier),
    n AS (SELECT *, list_filter(string_split(regexp_replace(x, '[.,]', '', 'g'), ' '), lambda w: w <> '') AS w, {_NAME_SQL} AS name FROM x)
    SELECT s_suppkey AS line, length(x) <= 70 AND NOT regexp_matches(x, '[?!:;]$') AND (regexp_matches(x, '{I.BYLINE_PREFIX}', 'i') OR (regexp_matches(x, '[a-z]') AND NOT regexp_matches(x, '{I.NOT_A_NAME}', 'i')
    AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda t: NOT regexp_matches(t, '^[A-Z]'))) = 0)) AS is_byline,
    CASE WHEN length(name) BETWEEN 1 AND 60 AND len(string_split(name, ' ')) <= 6 AND NOT regexp_matches(name, '{I.NOT_A_NAME}', 'i') THEN name END AS author FROM n""")
def bylines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.get(F.array(*map(F.lit, _LINES)), (F.col("s_suppkey") % 10).cast("int")), F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit(" "), "s_name")).otherwise(""))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), I.is_byline(line).alias("is_byline"), I.byline_name(line).alias("author"))


_BLOCKS_SQL = """
    WITH b AS (SELECT conv_id, turn, CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN 'image' ELSE 'paragraph' END AS kind, CASE (conv_id + turn) % 7 WHEN 0 THEN 'Synopsis ' || turn WHEN 1 THEN ' synopsis ' WHEN 2 THEN lower(left(text, 40)) || 'é'
    WHEN 3 THEN 'By Anil Kumar' WHEN 4 THEN NULL ELSE text END AS text FROM conversations),
    r AS (SELECT *, regexp_replace(coalesce(text, ''), '^[\\s\\x0B\\p{Z}]+|[\\s\\x0B\\p{Z}]+$', '', 'g') AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM b)
"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    n, text = (F.col("conv_id") + F.col("turn")) % 7, F.col("text")
    said = (
        F.when(n == 0, F.concat(F.lit("Synopsis "), "turn")).when(n == 1, " synopsis ").when(n == 2, F.concat(F.lower(F.substring(text, 1, 40)), F.lit("é")))
        .when(n == 3, "By Anil Kumar").when(n == 4, F.lit(None)).otherwise(text)
    )
    kind = F.when((F.col("conv_id") * 3 + F.col("turn")) % 5 == 0, "image").otherwise("paragraph")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), said.alias("text"))


@query(_BLOCKS_SQL + """,
    l AS (SELECT *, kind = 'paragraph' AND regexp_matches(own, '^synopsis\\s*\\d*$', 'i') AS label FROM r),
    p AS (SELECT *, n - coalesce(max(CASE WHEN NOT label THEN n END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS place, lead(CASE WHEN kind = 'paragraph' AND own <> '' THEN own END) OVER (PARTITION BY conv_id ORDER BY turn) AS body FROM l),
    t AS (SELECT *, label AND place % 2 = 1 AND body IS NOT NULL AS takes FROM p),
    g AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY conv_id ORDER BY turn), false) AS taken FROM t)
    SELECT conv_id, turn, CASE WHEN takes THEN 'callout' ELSE kind END AS kind, CASE WHEN takes THEN own END AS title, CASE WHEN takes THEN body ELSE text END AS text FROM g WHERE NOT taken""")
def synopsis_callouts(spark: SparkSession, d: str) -> DataFrame:
    return I.synopsis_callouts(_blocks(spark, d), "conv_id", "turn", "kind", "text")


@query(_BLOCKS_SQL + """,
    q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM r WHERE kind = 'paragraph'),
    m AS (SELECT a.conv_id, a.turn AS first, b.turn AS donor, b.own[1] || a.own || ' ' || regexp_replace(b.own[2:], '^[\\s\\x0B\\p{Z}]+', '') AS mended FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.p = 1 AND b.p = 2 AND b.n - a.n <= 3
    WHERE regexp_matches(a.own, '^\\p{Ll}') AND NOT regexp_matches(a.own, '[.!?:;”"’'')\\]]$') AND regexp_matches(b.own, '^\\p{Lu}\\p{Ll}'))
    SELECT r.conv_id, turn, kind, CASE WHEN turn = first THEN mended ELSE text END AS text FROM r LEFT JOIN m ON r.conv_id = m.conv_id WHERE turn IS DISTINCT FROM donor""")
def drop_caps(spark: SparkSession, d: str) -> DataFrame:
    return I.drop_caps_restored(_blocks(spark, d), "conv_id", "turn", "kind", "text")


@query(_BLOCKS_SQL + f""",
    s AS (SELECT *, regexp_extract(own, '{I.BYLINE.replace("'", "''")}', 1) AS name FROM r WHERE n <= 4 AND kind = 'paragraph' AND own <> ''),
    e AS (SELECT * FROM s WHERE length(own) > 60 OR name <> '')
    SELECT conv_id, turn, name AS author FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) WHERE length(own) <= 60""")
def extracted_authors(spark: SparkSession, d: str) -> DataFrame:
    return I.author_in(_blocks(spark, d), "conv_id", "turn", "kind", "text")


def _issue_pages(spark: SparkSession, d: str) -> DataFrame:
    """An issue is a source's documents of 200 ids in a row."""
    n = F.col("doc_id")
    return table(spark, d, "documents").select(F.concat_ws("/", "source", F.expr("doc_id div 200")).alias("issue"), (n % 200 + 1).alias("page"), n.alias("doc_id"), "text", "lang")


_PAGES_SQL = "WITH d AS (SELECT concat_ws('/', source, doc_id // 200) AS issue, doc_id % 200 + 1 AS page, doc_id, lang, text FROM documents)"


@query(_PAGES_SQL + """
    SELECT r.issue, r.doc_id AS entry, sha256(coalesce(string_agg(CASE WHEN p.page IS NOT NULL THEN chr(10) || coalesce(p.text, '') END, '' ORDER BY p.page), '')) AS text_sha256 FROM d r LEFT JOIN d p ON p.issue = r.issue AND p.page BETWEEN r.page AND least(r.page + r.doc_id % 6 - 1, r.page + 3) GROUP BY r.issue, r.doc_id""")
def texts_of_ranges(spark: SparkSession, d: str) -> DataFrame:
    """An entry on every page, over as many pages as its id says, none included; of these the first four."""
    pages = _issue_pages(spark, d)
    ranges = pages.select("issue", F.col("doc_id").alias("entry"), F.col("page").alias("start"), (F.col("page") + F.col("doc_id") % 6 - 1).alias("end"))
    out = I.text_of_ranges(ranges, pages.select("issue", "page", "text"), "issue", "page", "text", "entry", most=4)
    return out.select("issue", "entry", F.sha2("text", 256).alias("text_sha256"))


@query("""
    WITH m AS (SELECT conv_id, turn, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM conversations),
    p AS (SELECT conv_id, turn * 97 - 5 AS place FROM conversations)
    SELECT p.conv_id, place, m.turn AS element FROM p ASOF LEFT JOIN m ON p.conv_id = m.conv_id AND p.place >= m.at""")
def elements_of_offsets(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return I.elements_at(turns.select("conv_id", (F.col("turn") * 97 - 5).alias("place")), turns, "conv_id", "turn", "text", "place")


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'PDF' WHEN p_size % 2 = 0 THEN 'BLOCKS' END AS mode, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS category, CASE WHEN p_size % 3 <> 0 THEN 'DRAFT' ELSE 'PUBLISHED' END AS status,
    CASE WHEN p_size % 2 = 0 THEN p_type END AS summary, CASE WHEN p_size % 4 = 0 THEN p_type END AS live FROM part)
    SELECT p_partkey AS article, CASE WHEN mode IS DISTINCT FROM 'PDF' THEN NULL WHEN category IS NULL THEN 'category_missing' WHEN status <> 'DRAFT' THEN 'not_touched' WHEN summary IS NOT DISTINCT FROM live THEN 'unchanged' ELSE 'updated' END AS outcome FROM p""")
def resync(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    pairs = [(F.col("p_name"), F.col("p_name")), (F.when(n % 2 == 0, F.col("p_type")), F.when(n % 4 == 0, F.col("p_type")))]
    outcome = I.resync_outcome(F.when(n % 5 != 0, "PDF").when(n % 2 == 0, "BLOCKS"), F.when(n % 7 != 0, F.col("p_brand")), F.when(n % 3 != 0, "DRAFT").otherwise("PUBLISHED"), pairs)
    return table(spark, d, "part").select(F.col("p_partkey").alias("article"), outcome.alias("outcome"))


@query("""
    SELECT o_orderkey AS article, c_custkey AS recipient, CASE o_orderstatus WHEN 'F' THEN 'Your article was approved' WHEN 'P' THEN 'Your article was not approved' END AS heading,
    CASE o_orderstatus WHEN 'F' THEN '"' || o_orderkey || '" has been approved and is now published.' WHEN 'P' THEN '"' || o_orderkey || '" was rejected. Reason: ' || o_orderpriority END AS message
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'P')""")
def publisher_notices(spark: SparkSession, d: str) -> DataFrame:
    """What each article's own publisher is told; notices meet users by id."""
    kind = F.when(F.col("o_orderstatus") == "F", "ARTICLE_APPROVED").when(F.col("o_orderstatus") == "P", "ARTICLE_REJECTED")
    said = I.notice(kind, F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.lit(""), F.lit(""), "the site")
    rows = table(spark, d, "orders").filter("o_orderstatus IN ('F', 'P')").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("article"), F.col("c_custkey").alias("recipient"), said.alias("said")).select("article", "recipient", "said.heading", "said.message")


@query("""
    WITH s AS (SELECT s_suppkey, ['DRAFT', 'PUBLISHED', 'ARCHIVED'][1 + s_suppkey % 3] AS status, CASE WHEN s_nationkey % 2 = 0 THEN 'publish' ELSE 'archive' END AS command FROM supplier)
    SELECT s_suppkey AS magazine, CASE WHEN command = 'publish' AND status = 'DRAFT' THEN 'PUBLISHED' WHEN command = 'archive' THEN 'ARCHIVED' ELSE status END AS status,
    CASE WHEN status <> 'DRAFT' THEN '1997-01-01' WHEN command = 'publish' THEN '1999-05-05' END AS published_on,
    CASE WHEN command = 'publish' AND status <> 'DRAFT' THEN 'NOT_DRAFT' WHEN command = 'archive' AND status = 'ARCHIVED' THEN 'ALREADY_ARCHIVED' END AS code FROM s""")
def magazine_states(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(F.lit("DRAFT"), F.lit("PUBLISHED"), F.lit("ARCHIVED")), (F.col("s_suppkey") % 3).cast("int"))
    command = F.when(F.col("s_nationkey") % 2 == 0, "publish").otherwise("archive")
    out = I.magazine_command(command, status, F.when(status != "DRAFT", "1997-01-01"), F.lit("1999-05-05"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("magazine"), out.alias("out")).select("magazine", "out.status", F.col("out.published_at").alias("published_on"), "out.code")


@query("""
    SELECT conv_id, turn, regexp_replace(regexp_replace('p-' || conv_id || '_' || turn || '.png', '([0-9]+)', '000000000000\\1', 'g'), '[0-9]*([0-9]{12})', '\\1', 'g') AS sort_key FROM conversations""")
def natural_order_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("P-"), "conv_id", F.lit("_"), "turn", F.lit(".png"))
    return table(spark, d, "conversations").select("conv_id", "turn", I.natural_key(name).alias("sort_key"))


@query("""
    SELECT l_partkey AS image, count(*) AS uses, count(*) > 3 AS furniture FROM lineitem GROUP BY l_partkey""")
def repeated_images(spark: SparkSession, d: str) -> DataFrame:
    """Images used more than three times are page furniture."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("image")).agg(F.count(F.lit(1)).alias("uses"), (F.count(F.lit(1)) > 3).alias("furniture"))


@query("""
    SELECT source, count(*) FILTER (WHERE coalesce(text, '') = '') AS invalid, count(*) FILTER (WHERE coalesce(text, '') <> '' AND length(text) < 200) AS flagged, count(*) FILTER (WHERE length(text) >= 200) AS clean FROM documents GROUP BY source""")
def validation_tally(spark: SparkSession, d: str) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(size == 0).alias("invalid"), F.count_if((size > 0) & (size < 200)).alias("flagged"), F.count_if(size >= 200).alias("clean"))
