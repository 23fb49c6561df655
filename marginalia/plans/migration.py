"""Named queries of compared documents and a checked migration, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import migration as M
from marginalia.plans.registry import query
from marginalia.sources.tables import table


@query("""
    WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 11 = 0 AS other, (conv_id + turn) % 17 = 3 AS lost, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT conv_id, NOT bool_or(other OR lost) AS same FROM t GROUP BY conv_id""")
def republished(spark: SparkSession, d: str) -> DataFrame:
    """Turns are blocks. The served ones have a resolved url and other orders of keys; some payloads have an item's url changed, which counts, and some lack a block."""
    rows = table(spark, d, "conversations")
    n = F.col("conv_id") + F.col("turn")
    text, items = F.col("text"), lambda url: F.array(F.struct(F.lit(url).alias("url"), F.col("role").alias("label")))
    served = rows.select("conv_id", F.col("turn").alias("position"), F.col("role").alias("kind"), F.to_json(F.struct(text.alias("text"), F.lit("https://x").alias("url"), items("u").alias("items"), F.col("turn").alias("n"))).alias("content"))
    swapped = F.when(n % 11 == 0, F.to_json(F.struct(F.col("turn").alias("n"), items("v").alias("items"), text.alias("text")))).otherwise(F.to_json(F.struct(F.col("turn").alias("n"), F.array(F.struct(F.col("role").alias("label"), F.lit("u").alias("url"))).alias("items"), text.alias("text"))))
    payload = rows.filter(n % 17 != 3).select("conv_id", F.col("turn").alias("position"), F.col("role").alias("kind"), swapped.alias("content"))
    return M.same_blocks(served, payload, "conv_id")


_PLACED_SQL = """
    WITH m AS (SELECT s_suppkey AS magazine, s_name AS old FROM supplier),
    a AS (SELECT conv_id AS article, max(turn) FILTER (role = 'assistant') AS published, CASE WHEN conv_id % 3 = 0 THEN 0::BIGINT END AS pending FROM conversations GROUP BY conv_id),
    p AS (SELECT magazine, article FROM m JOIN a ON article = magazine WHERE magazine % 2 = 0 AND coalesce(pending, published) IS NOT NULL),
"""


def _moved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers are magazines; those with an even number have an editorial, the article of their number, if it has a version. Its neighbour is placed there under another label."""
    rows = table(spark, d, "conversations")
    article = F.col("conv_id").alias("article")
    magazines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("magazine"), F.col("s_name").alias("editorial_title"), *(F.lit(None).cast("string").alias(f"editorial_{x}") for x in ("author", "summary", "body")))
    articles = rows.groupBy(article).agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("published")).withColumn("pending", F.when(F.col("article") % 3 == 0, F.lit(0).cast("long")))
    versions = rows.select(article, F.col("turn").alias("version"), F.concat(F.lit("title "), "turn").alias("title"), F.col("role").alias("author_name"), F.col("text").alias("summary"))
    line = F.posexplode(F.split("text", "\n")).alias("position", "line")
    blocks = rows.filter("turn % 2 = 0").select(article, F.col("turn").alias("version"), line).select("article", "version", "position", F.lit("paragraph").alias("kind"), F.concat(F.lit('{"text":'), F.length("line").cast("string"), F.lit("}")).alias("content"))
    own = magazines.filter("magazine % 2 = 0").join(articles.filter("coalesce(pending, published) IS NOT NULL"), F.col("article") == F.col("magazine")).select("magazine", "article", F.lit("Editorial").alias("section"))
    placements = own.unionByName(own.select("magazine", (F.col("article") + 1).alias("article"), F.lit("Tutorial").alias("section")))
    return M.editorials_moved(magazines, placements, articles, versions, blocks)


@query(_PLACED_SQL + """
    b AS (SELECT conv_id AS article, turn AS version, '[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '{"blockType":"paragraph","content":{"text":' || length(x) || '}}'), ',') || ']' AS body FROM conversations WHERE turn % 2 = 0)
    SELECT m.magazine, CASE WHEN p.article IS NULL THEN old ELSE 'title ' || v.turn END AS editorial_title, v.role AS editorial_author, v.text AS editorial_summary, CASE WHEN p.article IS NOT NULL THEN coalesce(body, '[]') END AS editorial_body
    FROM m LEFT JOIN p USING (magazine) LEFT JOIN a USING (article) LEFT JOIN conversations v ON v.conv_id = p.article AND v.turn = coalesce(pending, published) LEFT JOIN b ON b.article = p.article AND b.version = v.turn""")
def editorials_in_magazines(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d)[0]


@query(_PLACED_SQL.rstrip().rstrip(",") + " SELECT article, published, pending FROM a WHERE article NOT IN (SELECT article FROM p)")
def articles_without_editorials(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d)[1]
