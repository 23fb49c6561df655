"""Named queries of search over postings, beside their SQL. SQL has no stems, so the query that it checks indexes words as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.stems import STOP_WORDS
from marginalia.operators import postings as S
from marginalia.plans.registry import query
from marginalia.sources.tables import table

SEARCH = 'tion re or "anea eriner" -worthless'
PAGE, LIMIT = 2, 20


def _fields() -> list:
    """Title: the first line. Subtitle and summary: the second line and what follows. Taxonomy: language and source. Author: the source's name and number."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rest = F.concat_ws(" ", F.get(lines, F.lit(1)), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n"))
    return [(F.get(lines, F.lit(0)), "A"), (rest, "B"), (F.concat_ws(" ", "lang", "source"), "C"), (F.concat(F.lit("ré "), "source"), "D")]


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEPT = lambda text: f"list_filter(list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda x, i: {{p: i, w: x}}), lambda s: s.w NOT IN ({_STOPS}))"


@query(f"""
    WITH d AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    f AS (SELECT doc_id, {_KEPT('l[1]')} AS a, {_KEPT("concat_ws(' ', l[2], array_to_string(l[3:], chr(10)))")} AS b, {_KEPT("lang || ' ' || source")} AS c, {_KEPT("'ré ' || source")} AS e FROM d),
    s AS (SELECT *, coalesce(a[-1].p, 0) AS sa, coalesce(b[-1].p, 0) AS sb, coalesce(c[-1].p, 0) AS sc FROM f),
    x AS (SELECT doc_id, unnest(list_concat(list_transform(a, lambda t: {{p: least(t.p, 16383), g: 1.0::DOUBLE, w: t.w}}), list_transform(b, lambda t: {{p: least(t.p + sa, 16383), g: 0.4::DOUBLE, w: t.w}}),
      list_transform(c, lambda t: {{p: least(t.p + sa + sb, 16383), g: 0.2::DOUBLE, w: t.w}}), list_transform(e, lambda t: {{p: least(t.p + sa + sb + sc, 16383), g: 0.1::DOUBLE, w: t.w}}))) AS x FROM s),
    o AS (SELECT doc_id, x.w AS w, x.p AS p, x.g AS g, row_number() OVER (PARTITION BY doc_id, x.w ORDER BY x.p, x.g) AS n FROM x WHERE x.w IN ('tion', 're', 'anea', 'eriner', 'worthless')),
    m AS (SELECT doc_id FROM o WHERE w = 'tion' INTERSECT (SELECT doc_id FROM o WHERE w = 're' UNION SELECT o.doc_id FROM o JOIN o q ON o.doc_id = q.doc_id AND o.w = 'anea' AND q.w = 'eriner' AND q.p = o.p + 1) EXCEPT SELECT doc_id FROM o WHERE w = 'worthless'),
    k AS (SELECT o.doc_id, exp(sum(ln(1 - sqrt(o.g * q.g * CASE WHEN abs(o.p - q.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(o.p - q.p) / 1.5 - 2)) END)))) AS remains
      FROM o JOIN q2 q ON o.doc_id = q.doc_id AND o.w > q.w AND o.p <> q.p WHERE o.n <= 256 AND q.n <= 256 AND o.w <> 'worthless' AND q.w <> 'worthless' GROUP BY o.doc_id),
    h AS (SELECT m.doc_id, round(CASE WHEN coalesce(remains, 1) < 1 THEN 1 - remains ELSE 1e-20 END, 6) AS rank FROM m LEFT JOIN k USING (doc_id) JOIN documents d USING (doc_id)
      WHERE lang IN ('en', 'fr') AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))
    SELECT doc_id, rank, count(*) OVER () AS total FROM h ORDER BY rank DESC, doc_id DESC LIMIT {LIMIT} OFFSET {(PAGE - 1) * LIMIT}""".replace("q2 q", "o q"))
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The second page of what matches in two languages (categories), in sources of ten documents (topics), and with a label (a tag), nearest terms first, then newest: a page report."""
    docs = table(spark, d, "documents")
    index = S.index_of(docs, "doc_id", _fields(), stemmed=False)
    hits = S.found(index, S.parse(SEARCH, stemmed=False), "doc_id").withColumn("rank", F.round("rank", 6))
    large = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 10").select("source")
    tagged = table(spark, d, "labels").filter("toxic = 0").select("doc_id")
    kept = docs.filter(F.col("lang").isin("en", "fr")).select("doc_id", "source").join(large, "source", "left_semi").join(tagged, "doc_id", "left_semi").select("doc_id")
    rows = hits.join(kept, "doc_id", "left_semi")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("rank"), F.desc("doc_id")).offset((PAGE - 1) * LIMIT).limit(LIMIT)
    return page.join(F.broadcast(total))


@query()
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """All matches with stems: of "readings", "ereations" or "Thons"."""
    return S.found(S.index_of(table(spark, d, "documents"), "doc_id", _fields()), S.parse("tions readings or thons or eas"), "doc_id")
