"""Named queries of where articles begin in an issue, each beside its SQL.

A source's documents of 200 ids in a row are an issue, each an article and a page; lines are elements, those of twelve words or fewer headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import segments as S
from marginalia.plans.registry import query
from marginalia.sources.tables import table

ISSUE_IDS = 200
_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


def _issue() -> Column:
    return F.concat_ws("-", "source", F.expr(f"doc_id div {ISSUE_IDS}").cast("string"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """issue, entry (from 1), doc_id, lang of all documents: texts aren't moved for it."""
    docs = table(spark, d, "documents").select(_issue().alias("issue"), "doc_id", "lang")
    return docs.withColumn("entry", F.row_number().over(Window.partitionBy("issue").orderBy("doc_id")).cast("long"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """issue, entry (from 1), doc_id, lang, text."""
    docs = table(spark, d, "documents").select(_issue().alias("issue"), "doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("entry", F.row_number().over(Window.partitionBy("issue").orderBy("doc_id")).cast("long"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """issue, doc_id, lang, n, text: the lines of documents."""
    docs = table(spark, d, "documents")
    return docs.select(_issue().alias("issue"), "doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))


def _kind() -> Column:
    return F.when(T.word_count(F.col("text")).between(1, 12), "heading").otherwise("paragraph")


def _placed(lines: DataFrame) -> DataFrame:
    """issue, position, kind, text of lines (with kind), numbered in order."""
    position = F.row_number().over(Window.partitionBy("issue").orderBy("doc_id", "n")) - 1
    return lines.select("issue", position.cast("long").alias("position"), "kind", "text")


_ISSUES_SQL = f"""
    WITH RECURSIVE d AS (SELECT source || '-' || (doc_id // {ISSUE_IDS}) AS issue, row_number() OVER (PARTITION BY source, doc_id // {ISSUE_IDS} ORDER BY doc_id) AS entry, doc_id, lang, coalesce(text, '') AS text FROM documents)"""
_LINES_SQL = """
    l AS (SELECT issue, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d{}),
    e AS (SELECT issue, row_number() OVER (PARTITION BY issue ORDER BY doc_id, n) - 1 AS position, CASE WHEN len(regexp_extract_all(text, '\\S+')) BETWEEN 1 AND 12 THEN 'heading' ELSE 'paragraph' END AS kind, text FROM l)"""
_TOKENS = "list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN (" + _STOPS + "))))"
_SEGMENTS_SQL = f"""{_ISSUES_SQL}, {_LINES_SQL.format('')},
    a AS (SELECT issue, entry, split_part(split_part(text, chr(10), 1), '.', 1) AS title, doc_id % 9 = 0 AS skip FROM d),
    h AS (SELECT issue, position, text, {_TOKENS.format('text')} AS t FROM e WHERE kind = 'heading'),
    rare AS (SELECT issue, w, count(*) AS n FROM (SELECT issue, unnest(t) AS w FROM h) GROUP BY ALL HAVING n = 1),
    h2 AS (SELECT issue, position, text, t, len(t) <= 3 AND len(list_intersect(t, coalesce(r.w, []))) > 0 AS short FROM h LEFT JOIN (SELECT issue, list(w) AS w FROM rare GROUP BY issue) r USING (issue)),
    b AS (SELECT issue, entry, {_TOKENS.format('title')} AS t FROM a WHERE NOT skip),
    c AS (SELECT b.issue, b.entry, h2.position, h2.text, len(list_intersect(b.t, h2.t)) AS s, CASE WHEN h2.short AND s = len(h2.t) THEN 1 ELSE round(2 * s / (len(b.t) + len(h2.t)), 9) END AS score FROM b JOIN h2 USING (issue) WHERE s > 0),
    f AS (SELECT DISTINCT issue, 0::BIGINT AS entry, 0::BIGINT AS floor, NULL::BIGINT AS start, NULL::VARCHAR AS heading, 0::DOUBLE AS score FROM d
    UNION ALL SELECT a.issue, a.entry, CASE WHEN len(k) > 0 THEN k[1].p + 1 ELSE floor END, CASE WHEN len(k) > 0 THEN k[1].p END, CASE WHEN len(k) > 0 THEN k[1].t END, CASE WHEN len(k) > 0 THEN -k[1].s ELSE 0 END FROM (
      SELECT a.issue, a.entry, any_value(f.floor) AS floor, list_sort(list({{s: -c.score, p: c.position, t: c.text}}) FILTER (WHERE c.score >= 0.6)) AS k
      FROM f JOIN a ON a.issue = f.issue AND a.entry = f.entry + 1 LEFT JOIN c ON c.issue = a.issue AND c.entry = a.entry AND c.position >= f.floor GROUP BY a.issue, a.entry) a),
    z AS (SELECT issue, count(*) AS n FROM e GROUP BY issue),
    y AS (SELECT issue, entry, coalesce(lead(start) OVER (PARTITION BY issue ORDER BY entry), z.n) - 1 AS "end" FROM f JOIN z USING (issue) WHERE start IS NOT NULL),
    seg AS (SELECT a.issue, a.entry, a.title, a.skip, f.start, y."end", f.heading AS matched_heading, coalesce(f.score, 0)::DOUBLE AS score, f.start IS NOT NULL AS confident FROM a JOIN f USING (issue, entry) LEFT JOIN y USING (issue, entry))
    """


def _segments(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).withColumn("kind", _kind())
    elements = _placed(lines.withColumn("text", F.when(F.col("kind") == "heading", F.col("text"))))  # other texts aren't looked at
    docs = table(spark, d, "documents").select("doc_id", F.split_part(T.first_line(F.col("text")), F.lit("."), F.lit(1)).alias("title"))
    articles = _numbered(spark, d).join(docs, "doc_id").select("issue", "entry", "title", (F.col("doc_id") % 9 == 0).alias("skip"))
    return S.heading_segments(elements, articles)


@query(_SEGMENTS_SQL + "SELECT * FROM seg")
def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    """Titles are the first sentences of documents, headings their short lines; every ninth entry is front matter and skipped."""
    return _segments(spark, d)


@query(_SEGMENTS_SQL + """,
    u AS (SELECT issue, position, kind, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS text FROM e),
    v AS (SELECT *, lag(text) OVER (PARTITION BY issue ORDER BY position) AS b FROM u WHERE text <> '')
    SELECT v.issue, v.position, seg.entry, CASE WHEN b IS NOT NULL AND NOT regexp_matches(b, '[.!?:;”"’'')\\]]$') THEN 'orphan-fragment' ELSE 'dropped-capital' END AS kind, v.text[1:90] AS text
    FROM v JOIN seg ON seg.issue = v.issue AND v.position BETWEEN seg.start AND seg."end" AND NOT seg.skip WHERE v.kind = 'paragraph' AND regexp_matches(v.text, '^[a-z]')""")
def prose_problems(spark: SparkSession, d: str) -> DataFrame:
    """Of the articles that headings were found for."""
    return S.prose_problems(_placed(_lines(spark, d).withColumn("kind", _kind())), _segments(spark, d))


_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""{_ISSUES_SQL}, {_LINES_SQL.format(" WHERE lang <> 'es'")},
    n AS (SELECT issue, position, {_NORMAL.format('text')} AS t FROM e),
    m AS (SELECT issue, position, t, sum(length(t) + 1) OVER (PARTITION BY issue ORDER BY position) - length(t) - 1 AS o FROM n WHERE t <> ''),
    hay AS (SELECT issue, string_agg(t || ' ', '' ORDER BY position) AS text, list(o ORDER BY position) AS ats, list(position ORDER BY position) AS els FROM m GROUP BY issue),
    p AS (SELECT issue, entry, list_filter(list_transform(string_split(text, chr(10)), lambda x: string_split({_NORMAL.format('x')}, ' ')), lambda w: len(w) >= 9) AS w FROM d),
    q AS (SELECT issue, entry, list_transform(w, lambda x: array_to_string(x[1:9], ' ')) AS q FROM p),
    a AS (SELECT d.issue, d.entry, least(d.entry + d.doc_id % 2, last) AS end_page, list_concat(q.q, CASE WHEN d.doc_id % 2 = 1 THEN coalesce(q2.q, []) ELSE [] END) AS q FROM d JOIN q USING (issue, entry)
      LEFT JOIN q q2 ON q2.issue = d.issue AND q2.entry = d.entry + 1 JOIN (SELECT issue, max(entry) AS last FROM d GROUP BY issue) USING (issue)),
    a2 AS (SELECT issue, entry, list_filter(q, lambda x, i: list_position(q, x) = i)[1:14] AS probes FROM a),
    f AS (SELECT DISTINCT issue, 0::BIGINT AS entry, 0::BIGINT AS floor, NULL::BIGINT AS position, NULL::VARCHAR AS probe, 0::BIGINT AS matched, 0::BIGINT AS tried FROM d
    UNION ALL SELECT issue, entry, CASE WHEN k IS NULL THEN floor ELSE coalesce(ats[i + 1], length(text)) END, CASE WHEN k IS NOT NULL THEN els[i] END, CASE WHEN k IS NOT NULL THEN probes[list_position(hits, k)] END, matched, len(probes) FROM (
      SELECT *, list_min(list_filter(hits, lambda x: x > 0)) AS k, len(list_filter(hits, lambda x: x > 0)) AS matched, len(list_filter(ats, lambda x: x <= floor + k - 1)) AS i FROM (
        SELECT a2.issue, a2.entry, a2.probes, f.floor, coalesce(hay.text, '') AS text, coalesce(ats, []) AS ats, coalesce(els, []) AS els, list_transform(a2.probes, lambda x: strpos(substr(coalesce(hay.text, ''), f.floor + 1), x)) AS hits
        FROM f JOIN a2 ON a2.issue = f.issue AND a2.entry = f.entry + 1 LEFT JOIN hay ON hay.issue = a2.issue))),
    nx AS (SELECT *, first_value(CASE WHEN position IS NOT NULL THEN {{p: position, e: entry}} END IGNORE NULLS) OVER (PARTITION BY issue ORDER BY entry ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM f WHERE entry > 0),
    r AS (SELECT DISTINCT issue, 0::BIGINT AS entry, NULL::BIGINT AS position, NULL::BIGINT AS page FROM d
    UNION ALL SELECT issue, entry, here, CASE WHEN here IS NULL THEN page ELSE entry END FROM (
      SELECT nx.issue, nx.entry, r.page, CASE WHEN nx.position IS NOT NULL THEN nx.position WHEN r.position IS NULL OR nxt IS NULL THEN NULL
        ELSE least(greatest(floor(r.position + (nx.entry - r.page) / (nxt.e - r.page) * (nxt.p - r.position) + 0.5)::BIGINT, r.position + 1), nxt.p - 1) END AS here
      FROM r JOIN nx ON nx.issue = r.issue AND nx.entry = r.entry + 1)),
    sizes AS (SELECT issue, count(*) AS n FROM e GROUP BY issue),
    s AS (SELECT issue, entry, position, coalesce(lead(position) OVER (PARTITION BY issue ORDER BY entry), n) - 1 AS end_position FROM r LEFT JOIN sizes USING (issue) WHERE position IS NOT NULL)
    SELECT f.issue, f.entry, s.position, s.end_position, f.probe, f.matched AS probes_matched, f.tried AS probes_tried, f.probe IS NOT NULL AS confident, f.probe IS NULL AND s.position IS NOT NULL AS estimated
    FROM f LEFT JOIN s USING (issue, entry) WHERE f.entry > 0""")
def anchors_with_floor(spark: SparkSession, d: str) -> DataFrame:
    """Spanish documents are pages that are a picture only: they aren't among the elements. Articles with an odd id end on the page after their first."""
    docs = _numbered(spark, d)
    last = F.max("entry").over(Window.partitionBy("issue"))
    articles = docs.select("issue", "entry", F.col("entry").alias("start_page"), F.least(F.col("entry") + F.col("doc_id") % 2, last).alias("end_page"))
    elements = _lines(spark, d).filter("lang <> 'es'").select("issue", F.struct("doc_id", "n").alias("position"), "text")
    probes = table(spark, d, "documents").select("doc_id", S.page_probes(F.col("text")).alias("probes"))
    pages = docs.join(probes, "doc_id").select("issue", F.col("entry").alias("page"), "probes")
    return S.anchored_articles(elements, articles, pages)
