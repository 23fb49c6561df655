"""Named queries of editorial commands on versions, each beside its SQL. Conversations stand for articles, their turns for versions, lines of a turn's text for a version's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import versions as V
from marginalia.plans.registry import query
from marginalia.sources.tables import table

FIELDS = ["title", "summary", "content_mode", "pdf_pages"]
COMMANDS = ("save", "revise", "edit_published", "approve", "publish", "save", "archive")
STATES = ("PENDING_REVIEW", "PENDING_REVIEW", "DRAFT", "REJECTED")
NOW = "2024-02-01 00:00:00"

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SQL = f"""
    WITH p AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN max(turn) FILTER (role = 'assistant') END AS published, CASE WHEN conv_id % 3 > 0 THEN max(turn) + CASE WHEN conv_id % 17 = 0 THEN 100 ELSE 0 END END AS newest, count(*) AS n FROM conversations GROUP BY conv_id),
    a AS (SELECT conv_id AS article, conv_id % 10 AS owner, published, CASE WHEN newest IS DISTINCT FROM published THEN newest END AS pending, CASE WHEN published IS NULL THEN 'DRAFT' ELSE 'PUBLISHED' END AS status, n FROM p),
    v AS (SELECT conv_id AS article, turn AS version, CASE WHEN turn = published THEN 'PUBLISHED' WHEN turn = pending THEN {_LIST(STATES)}[1 + conv_id % 4] ELSE 'SUPERSEDED' END AS status, turn + 1 AS minutes, role AS title, text AS summary, CASE WHEN turn % 4 = 3 THEN 'PDF' ELSE 'BLOCKS' END AS content_mode, turn AS pdf_pages FROM conversations JOIN a ON article = conv_id),
    b AS (SELECT conv_id AS article, turn AS version, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS position FROM conversations),
    c AS (SELECT article AS seq, article, {_LIST(COMMANDS)}[1 + article % 7] AS command, CASE WHEN article % 11 = 0 THEN 999 ELSE owner END AS actor, CASE WHEN article % 4 = 1 THEN 'PUBLISHER' ELSE 'ADMIN' END AS role, 1 AS turn FROM a
    UNION ALL SELECT article + 1000000, article, 'approve', 1, 'ADMIN', 2 FROM a WHERE article % 13 = 0 UNION ALL SELECT article + 2000000, article + 5000000, 'save', 1, 'ADMIN', 1 FROM a WHERE article % 29 = 0),
    k AS (SELECT c.*, a.owner, a.published, a.pending, a.n, v.status AS state, v.version AS source FROM c LEFT JOIN a USING (article) LEFT JOIN v ON v.article = c.article AND v.version = CASE WHEN command = 'revise' THEN a.published ELSE a.pending END),
    o AS (SELECT *, CASE WHEN turn = 2 THEN 'CONFLICT' WHEN owner IS NULL THEN 'NOT_FOUND' WHEN command = 'archive' THEN 'UNKNOWN_COMMAND' WHEN command IN ('approve', 'publish', 'edit_published') AND role <> 'ADMIN' THEN 'FORBIDDEN'
      WHEN owner <> actor AND (command = 'revise' OR (command = 'save' AND role <> 'ADMIN')) THEN 'NOT_FOUND' WHEN command = 'save' AND pending IS NULL THEN 'NO_EDITABLE_VERSION' WHEN command IN ('approve', 'publish') AND pending IS NULL THEN 'NO_PENDING_VERSION'
      WHEN command IN ('revise', 'edit_published') AND published IS NULL THEN 'NOT_PUBLISHED' WHEN command IN ('revise', 'edit_published') AND pending IS NOT NULL THEN 'REVISION_IN_PROGRESS' WHEN command <> 'edit_published' AND source IS NULL THEN 'NOT_FOUND'
      WHEN command = 'save' AND state NOT IN ('DRAFT', 'REJECTED') THEN 'VERSION_NOT_EDITABLE' WHEN command = 'approve' AND state <> 'PENDING_REVIEW' THEN 'NOT_PENDING_REVIEW' END AS code FROM k),
    g AS (SELECT *, CASE WHEN command IN ('revise', 'edit_published') THEN n + 1 ELSE pending END AS target, command IN ('approve', 'publish', 'edit_published') AS live FROM o WHERE code IS NULL),
    pay AS (SELECT conv_id AS article, 'edited' AS title, text AS summary, CASE WHEN conv_id % 3 = 0 THEN 'PDF' ELSE 'BLOCKS' END AS content_mode, conv_id % 9 AS pdf_pages FROM conversations WHERE turn = 0),
    mins AS (SELECT pay.article, CASE WHEN content_mode = 'PDF' THEN greatest(1, 2 * pdf_pages) ELSE greatest(1, ceil(sum(len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'))) / 200)) END::BIGINT AS minutes FROM pay JOIN b ON b.article = pay.article AND b.version = 0 GROUP BY pay.article, content_mode, pdf_pages),
    nv AS (SELECT g.article, g.target AS version, CASE WHEN command = 'revise' THEN 'DRAFT' ELSE 'PUBLISHED' END AS status, CASE WHEN command = 'revise' THEN v.minutes ELSE m.minutes END AS minutes, CASE WHEN command = 'revise' THEN v.title ELSE pay.title END AS title,
      CASE WHEN command = 'revise' THEN v.summary ELSE pay.summary END AS summary, CASE WHEN command = 'revise' THEN v.content_mode ELSE pay.content_mode END AS content_mode, CASE WHEN command = 'revise' THEN v.pdf_pages ELSE pay.pdf_pages END AS pdf_pages
      FROM g LEFT JOIN v ON v.article = g.article AND v.version = g.published LEFT JOIN pay ON pay.article = g.article LEFT JOIN mins m ON m.article = g.article WHERE command IN ('revise', 'edit_published')),
    vs AS (SELECT v.article, v.version, CASE WHEN g.live AND v.version = g.target THEN 'PUBLISHED' WHEN g.live AND v.version = g.published THEN 'SUPERSEDED' ELSE v.status END AS status, s AS saved,
      CASE WHEN s THEN m.minutes ELSE v.minutes END AS minutes, CASE WHEN s THEN pay.title ELSE v.title END AS title, CASE WHEN s THEN pay.summary ELSE v.summary END AS summary, CASE WHEN s THEN pay.content_mode ELSE v.content_mode END AS content_mode, CASE WHEN s THEN pay.pdf_pages ELSE v.pdf_pages END AS pdf_pages
      FROM v LEFT JOIN g ON g.article = v.article LEFT JOIN pay ON pay.article = v.article LEFT JOIN mins m ON m.article = v.article, LATERAL (SELECT coalesce(g.command = 'save' AND v.version = g.target, false) AS s)),
    nvs AS (SELECT article, version, status, minutes, title, summary, content_mode, pdf_pages FROM vs UNION ALL SELECT * FROM nv)"""


def _applied(spark: SparkSession, d: str) -> V.Tables:
    rows = table(spark, d, "conversations")
    n = F.col("article")
    p = rows.groupBy(F.col("conv_id").alias("article")).agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_p"), F.max("turn").alias("_n"))
    p = p.select("article", F.when(n % 2 == 0, F.col("_p")).alias("published"), F.when(n % 3 > 0, F.col("_n") + F.when(n % 17 == 0, 100).otherwise(0)).alias("_n"))
    snapshot = [F.lit("old").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("BLOCKS").alias("content_mode"), F.lit(0).cast("long").alias("pdf_pages")]
    articles = p.select(
        "article", (n % 10).alias("owner"), F.when(F.col("published").isNull(), "DRAFT").otherwise("PUBLISHED").alias("status"), "published",
        F.when(~F.col("_n").eqNullSafe(F.col("published")), F.col("_n")).alias("pending"), F.lit(None).cast("timestamp").alias("published_at"), *snapshot,
    )
    turn = F.col("turn")
    own = rows.withColumnRenamed("conv_id", "article").join(articles.select("article", "published", "pending"), "article")
    status = F.when(turn == F.col("published"), "PUBLISHED").when(turn == F.col("pending"), F.get(F.array(*(F.lit(s) for s in STATES)), (n % 4).cast("int"))).otherwise("SUPERSEDED")
    versions = own.select(
        "article", turn.alias("version"), status.alias("status"), F.lit(None).cast("long").alias("created_by"), (turn + 1).alias("minutes"), F.col("role").alias("title"), F.col("text").alias("summary"),
        F.when(turn % 4 == 3, "PDF").otherwise("BLOCKS").alias("content_mode"), turn.alias("pdf_pages"),
    )
    lines = rows.select(F.col("conv_id").alias("article"), turn.alias("version"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "line"))
    blocks = lines.select("article", "version", "position", F.lit("paragraph").alias("kind"), F.to_json(F.struct(F.col("line").alias("text"))).alias("content"))
    first = rows.filter("turn = 0").select(F.col("conv_id").alias("article"), F.col("text").alias("summary"))
    payload = F.struct(F.lit("edited").alias("title"), "summary", F.when(n % 3 == 0, "PDF").otherwise("BLOCKS").alias("content_mode"), (n % 9).alias("pdf_pages"))
    base = articles.select("article", "owner").join(first, "article")
    admin, nothing = F.lit("ADMIN"), F.lit(None)
    one = base.select(n.alias("seq"), "article", F.get(F.array(*(F.lit(c) for c in COMMANDS)), (n % 7).cast("int")).alias("command"), F.when(n % 11 == 0, 999).otherwise(F.col("owner")).alias("actor"), F.when(n % 4 == 1, "PUBLISHER").otherwise("ADMIN").alias("role"), payload.alias("payload"))
    kind = one.schema["payload"].dataType
    two = base.filter(n % 13 == 0).select((n + 1_000_000).alias("seq"), "article", F.lit("approve").alias("command"), F.lit(1).cast("long").alias("actor"), admin.alias("role"), nothing.cast(kind).alias("payload"))
    lost = base.filter(n % 29 == 0).select((n + 2_000_000).alias("seq"), (n + 5_000_000).alias("article"), F.lit("save").alias("command"), F.lit(1).cast("long").alias("actor"), admin.alias("role"), nothing.cast(kind).alias("payload"))
    given = blocks.filter("version = 0").select(n.alias("seq"), "position", "kind", "content")
    return V.applied(one.unionByName(two).unionByName(lost), given, articles, versions, blocks, FIELDS, F.lit(NOW).cast("timestamp"))


@query(_SQL + " SELECT o.seq, o.article, o.command, o.code, g.target AS version FROM o LEFT JOIN g USING (seq)")
def command_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).decided


@query(_SQL + f""" SELECT a.article, owner, CASE WHEN live THEN 'PUBLISHED' ELSE a.status END AS status, CASE WHEN live THEN target ELSE a.published END AS published, CASE WHEN live THEN NULL WHEN g.command = 'revise' THEN target ELSE a.pending END AS pending,
    live IS TRUE AS republished, CASE WHEN put THEN w.title ELSE 'old' END AS title, CASE WHEN put THEN w.summary END AS summary, CASE WHEN put THEN w.content_mode ELSE 'BLOCKS' END AS content_mode, CASE WHEN put THEN w.pdf_pages ELSE 0 END AS pdf_pages
    FROM a LEFT JOIN (SELECT article, command, target, live, published AS before FROM g) g USING (article) LEFT JOIN nvs w ON w.article = a.article AND w.version = g.target, LATERAL (SELECT coalesce(live OR (g.command = 'save' AND a.published IS NULL), false) AS put)""")
def edited_articles(spark: SparkSession, d: str) -> DataFrame:
    out = _applied(spark, d).articles
    return out.withColumn("republished", F.col("published_at").isNotNull()).drop("published_at")


@query(_SQL + " SELECT * FROM nvs")
def revised_versions(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).versions.drop("created_by")


@query(_SQL + """ SELECT b.article, b.version, b.position::BIGINT AS position, b.line FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.article = b.article AND g.target = b.version AND command = 'save')
    UNION ALL SELECT g.article, g.target, b.position, b.line FROM g JOIN b ON b.article = g.article AND b.version = CASE WHEN command = 'revise' THEN g.published ELSE 0 END WHERE command IN ('save', 'edit_published', 'revise')""")
def revised_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).blocks.select("article", "version", F.col("position").cast("long").alias("position"), F.get_json_object("content", "$.text").alias("line"))


@query(_SQL + """ SELECT article, CASE command WHEN 'approve' THEN 'APPROVED' ELSE 'PUBLISHED_DIRECT' END AS event, actor AS user_id FROM g WHERE live
    UNION ALL SELECT article, 'article_published', NULL FROM g WHERE live AND published IS NULL UNION ALL SELECT article, 'article_approved', owner FROM g WHERE live AND published IS NULL AND owner <> actor""")
def reviews_and_notices(spark: SparkSession, d: str) -> DataFrame:
    out = _applied(spark, d)
    return out.reviews.select("article", F.col("action").alias("event"), F.col("actor").alias("user_id")).unionByName(out.notices.select("article", F.col("kind").alias("event"), "user_id"))
