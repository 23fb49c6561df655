"""Named queries of editorial commands and small readers, each beside its SQL. Which table stands for what is in ``plans.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import editorial as E
from marginalia.operators import reading as G
from marginalia.plans.registry import query
from marginalia.sources.tables import table

SECRET = "a secret for tests"
_PADS = [bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]
_TRIM_SQL = "regexp_replace({}, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')"


@query("""
    SELECT p_partkey AS version, array_to_string(list_filter([CASE WHEN p_size % 11 = 0 THEN 'title' END, CASE WHEN p_size % 5 IN (0, 1) THEN 'summary' END, CASE WHEN p_brand = 'Brand#3' THEN 'author_name' END,
    CASE WHEN p_size % 7 = 0 THEN 'category' END, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 1 THEN 'pdf_media' END, CASE WHEN p_size % 3 <> 0 AND p_size % 4 = 0 THEN 'blocks' END], lambda x: x IS NOT NULL), ',') AS missing FROM part""")
def submit_gate(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(size % 11 != 0, F.col("p_name")).alias("title"), F.when(size % 5 == 0, F.lit(" \n ")).when(size % 5 != 1, F.col("p_type")).alias("summary"),
        F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).otherwise("").alias("author_name"), F.when(size % 7 != 0, size).alias("category"),
        F.when(size % 3 == 0, "PDF").when(size % 3 == 1, "BLOCKS").alias("content_mode"), F.when(size % 2 == 0, size).alias("pdf_media"), (size % 4).alias("blocks"),
    )
    return rows.select(F.col("p_partkey").alias("version"), F.array_join(E.missing_to_submit(), ",").alias("missing"))


@query(f"""
    WITH d AS (SELECT doc_id, {_TRIM_SQL.format("split_part(coalesce(text, ''), chr(10), 1)")} AS title, {_TRIM_SQL.format("coalesce(text, '')")} AS body, CASE WHEN source = 'src_1' THEN '' ELSE coalesce(source, '') END AS author, lang,
    CASE lang WHEN 'fr' THEN 'PDF' WHEN 'es' THEN 'HTML' WHEN 'de' THEN NULL ELSE 'BLOCKS' END AS mode FROM documents)
    SELECT doc_id, length(title) AS title_chars, coalesce(mode, 'BLOCKS') AS content_mode, array_to_string(list_filter([
    CASE WHEN title = '' THEN 'title: required' END, CASE WHEN author = '' THEN 'author_name: required' END, CASE WHEN length(title) > 300 THEN 'title: too long' END, CASE WHEN length(body) > 400 THEN 'subtitle: too long' END,
    CASE WHEN length(body) > 2000 THEN 'summary: too long' END, CASE WHEN length(author) > 200 THEN 'author_name: too long' END, CASE WHEN doc_id % 3 = 0 THEN 'category: not a uuid' END, CASE WHEN mode = 'HTML' THEN 'content_mode: unknown' END,
    CASE WHEN mode = 'PDF' AND doc_id % 2 = 0 THEN 'pdf_media: required' END, CASE WHEN doc_id % 5 = 1 AND doc_id % 2 = 1 THEN 'pdf_media: not a uuid' END, CASE WHEN doc_id % 4000 - 5 NOT BETWEEN 1 AND 2000 THEN 'pdf_pages: out of range' END
    ], lambda x: x IS NOT NULL), ';') AS errors FROM d""")
def version_payloads(spark: SparkSession, d: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("text")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    mode = F.when(F.col("lang") == "fr", "PDF").when(F.col("lang") == "es", "HTML").when(F.col("lang") == "de", F.lit(None)).otherwise("BLOCKS")
    rows = table(spark, d, "documents").select(
        "doc_id", T.first_line(text).alias("title"), text.alias("subtitle"), text.alias("summary"), F.when(F.col("source") == "src_1", "").otherwise(F.col("source")).alias("author_name"), F.lit(None).cast("string").alias("author_bio"),
        F.when(n % 3 == 0, "none").otherwise(uuid).alias("category"), mode.alias("content_mode"), F.when(n % 2 == 1, F.when(n % 5 == 1, "x").otherwise(uuid)).alias("pdf_media"), (n % 4000 - 5).alias("pdf_pages"),
    )
    return E.parsed_versions(rows, ["doc_id"]).select("doc_id", F.length("title").cast("long").alias("title_chars"), "content_mode", F.array_join("errors", ";").alias("errors"))


@query("""
    WITH k AS (SELECT p_partkey, ['image/jpeg', 'image/png', 'text/html', 'application/pdf', 'image/gif', NULL][1 + p_size % 6] AS kind, CAST(floor(p_retailprice * 17000) AS BIGINT) // CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS size FROM part)
    SELECT p_partkey AS upload, CASE WHEN kind IS NULL OR kind = 'text/html' THEN 'UNSUPPORTED_FILE_TYPE' WHEN size > CASE kind WHEN 'application/pdf' THEN 26214400 ELSE 10485760 END THEN 'FILE_TOO_LARGE' END AS code FROM k""")
def upload_rules(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("image/jpeg", "image/png", "text/html", "application/pdf", "image/gif", None)))
    size = F.expr("cast(floor(p_retailprice * 17000) as bigint) div if(p_size % 2 = 0, 3, 1)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("upload"), E.upload_code(F.get(kinds, F.col("p_size") % 6), size).alias("code"))


@query("""
    WITH r AS (SELECT o_custkey AS m, 'covers' AS c FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT s_suppkey, 'covers' FROM supplier UNION ALL SELECT o_custkey, 'pdfs' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 2 * s_suppkey, 'pdfs' FROM supplier
    UNION ALL SELECT conv_id, 'version_covers' FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 'version_pdfs' FROM conversations WHERE role = 'system' UNION ALL SELECT 3 * s_suppkey, 'author_images' FROM supplier
    UNION ALL SELECT CAST(json_extract_string(props, '$.k') AS BIGINT), 'blocks' FROM events UNION ALL SELECT m, 'blocks' FROM (SELECT DISTINCT n_nationkey, m FROM (SELECT n_nationkey, unnest([n_nationkey * 60, n_regionkey * 300]) AS m FROM nation))),
    u AS (SELECT p_partkey AS media, count(*) FILTER (c = 'covers') AS covers, count(*) FILTER (c = 'pdfs') AS pdfs, count(*) FILTER (c = 'version_covers') AS version_covers, count(*) FILTER (c = 'version_pdfs') AS version_pdfs,
    count(*) FILTER (c = 'author_images') AS author_images, count(*) FILTER (c = 'blocks') AS blocks FROM part LEFT JOIN r ON m = p_partkey GROUP BY p_partkey)
    SELECT *, 'Still in use — ' || nullif(array_to_string(list_filter([CASE WHEN covers > 0 THEN covers || ' cover image use(s)' END, CASE WHEN pdfs > 0 THEN pdfs || ' PDF attachment use(s)' END, CASE WHEN version_covers > 0 THEN version_covers || ' draft/revision cover use(s)' END,
    CASE WHEN version_pdfs > 0 THEN version_pdfs || ' draft/revision PDF use(s)' END, CASE WHEN author_images > 0 THEN author_images || ' editorial author image use(s)' END, CASE WHEN blocks > 0 THEN blocks || ' embedded content block use(s)' END], lambda x: x IS NOT NULL), ', '), '') AS reason FROM u""")
def media_deletion(spark: SparkSession, d: str) -> DataFrame:
    """Nine references in six counters; a magazine whose editorial shows a medium twice refers to it once."""
    ref = lambda rows, c: rows.select(F.expr(c).cast("long").alias("media"))
    orders, magazines, turns = table(spark, d, "orders"), table(spark, d, "supplier"), table(spark, d, "conversations")
    bodies = table(spark, d, "nation").select(F.explode(F.array_distinct(F.array(F.col("n_nationkey") * 60, F.col("n_regionkey") * 300))).alias("m"))
    counters = {
        "covers": [ref(orders.filter("o_orderstatus = 'F'"), "o_custkey"), ref(magazines, "s_suppkey")], "pdfs": [ref(orders.filter("o_orderstatus = 'P'"), "o_custkey"), ref(magazines, "2 * s_suppkey")],
        "version_covers": [ref(turns.filter("role = 'user'"), "conv_id")], "version_pdfs": [ref(turns.filter("role = 'system'"), "conv_id")], "author_images": [ref(magazines, "3 * s_suppkey")],
        "blocks": [ref(table(spark, d, "events"), "get_json_object(props, '$.k')"), ref(bodies, "m")],
    }
    names = ["cover image", "PDF attachment", "draft/revision cover", "draft/revision PDF", "editorial author image", "embedded content block"]
    out = E.media_references(ref(table(spark, d, "part"), "p_partkey"), "media", counters)
    return out.withColumn("reason", E.use_reason(dict(zip(counters, names, strict=True))))


@query("""
    SELECT event_id AS block, event_type <> 'error' AS has_url, CASE WHEN event_type <> 'error' THEN n_name END AS url FROM events LEFT JOIN nation ON n_nationkey = CAST(json_extract_string(props, '$.k') AS INT)""")
def block_media_urls(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("event_type") == "error", F.create_map(F.lit("text"), F.lit("x"))).otherwise(F.create_map(F.lit("mediaId"), F.get_json_object("props", "$.k")))
    blocks = table(spark, d, "events").select(F.col("event_id").alias("block"), content.alias("content"))
    media = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("media_id"), F.col("n_name").alias("url"))
    return E.with_media_urls(blocks, media).select("block", F.map_contains_key("content", "url").alias("has_url"), F.try_element_at("content", F.lit("url")).alias("url"))


_VERSIONS_SQL = """
    WITH a AS (SELECT conv_id AS article, CASE WHEN conv_id % 2 = 0 THEN max(turn) FILTER (role = 'assistant') END AS published, CASE WHEN conv_id % 3 > 0 THEN max(turn) + CASE WHEN conv_id % 17 = 0 THEN 100 ELSE 0 END END AS newest FROM conversations GROUP BY conv_id),
    p AS (SELECT article, published, CASE WHEN newest IS DISTINCT FROM published THEN newest END AS pending FROM a)
"""


def _versioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "conversations")
    pointers = rows.groupBy(F.col("conv_id").alias("article")).agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_p"), F.max("turn").alias("_n"))
    pointers = pointers.select("article", F.when(F.col("article") % 2 == 0, F.col("_p")).alias("published"), F.when(F.col("article") % 3 > 0, F.col("_n") + F.when(F.col("article") % 17 == 0, 100).otherwise(0)).alias("_n"))
    articles = pointers.select("article", "published", F.when(~F.col("_n").eqNullSafe(F.col("published")), F.col("_n")).alias("pending"), F.lit("old").alias("title"), F.lit(0).alias("chars"))
    versions = rows.select(F.col("conv_id").alias("article"), F.col("turn").alias("version"), F.col("role").alias("title"), F.length("text").alias("chars"))
    status = F.when(F.col("version") == F.col("published"), "PUBLISHED").when((F.col("version") == F.col("pending")) & (F.col("article") % 5 > 0), "PENDING_REVIEW").otherwise("DRAFT")
    versions = versions.join(articles.select("article", "published", "pending"), "article").withColumn("status", status).drop("published", "pending")
    return articles, versions


@query(_VERSIONS_SQL + """
    SELECT article, CASE WHEN turn IS NULL THEN published ELSE pending END AS published, CASE WHEN turn IS NULL THEN pending END AS pending, coalesce(role, 'old') AS title, coalesce(length(text), 0) AS chars, turn IS NOT NULL AND published IS NULL AS first_publish
    FROM p LEFT JOIN conversations ON conv_id = article AND turn = pending AND conv_id % 5 > 0""")
def approved_articles(spark: SparkSession, d: str) -> DataFrame:
    out, _ = E.promoted(*_versioned(spark, d), ["title", "chars"])
    return out.select("article", "published", "pending", "title", F.col("chars").cast("long"), "first_publish")


@query(_VERSIONS_SQL + """
    SELECT article, turn AS version, CASE WHEN turn = pending AND conv_id % 5 > 0 THEN 'PUBLISHED' WHEN turn = published AND EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = article AND c.turn = pending AND c.conv_id % 5 > 0) THEN 'SUPERSEDED' WHEN turn = published THEN 'PUBLISHED' ELSE 'DRAFT' END AS status
    FROM conversations JOIN p ON conv_id = article""")
def approved_versions(spark: SparkSession, d: str) -> DataFrame:
    _, out = E.promoted(*_versioned(spark, d), ["title", "chars"])
    return out.select("article", "version", "status")


_PLACED_SQL = """
    WITH p AS (SELECT o_orderkey AS article, o_custkey % 100 AS magazine, o_orderpriority AS section, o_orderkey % 7 AS display_order FROM orders)
"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("article"), (F.col("o_custkey") % 100).alias("magazine"), F.col("o_orderpriority").alias("section"), (F.col("o_orderkey") % 7).alias("display_order"))


@query(_PLACED_SQL + """
    , r AS (SELECT o_orderkey AS article, CASE WHEN o_orderstatus = 'F' THEN (o_custkey + o_orderkey % 2) % 100 END AS magazine, o_orderkey % 3 = 0 AS given FROM orders WHERE o_orderstatus <> 'O'),
    t AS (SELECT * FROM p WHERE article NOT IN (SELECT article FROM r) UNION ALL SELECT p.article, p.magazine, CASE WHEN given THEN 'S' ELSE section END, display_order FROM p JOIN r ON p.article = r.article AND p.magazine = r.magazine),
    f AS (SELECT r.article, r.magazine, CASE WHEN given THEN 'S' END AS section, row_number() OVER (PARTITION BY r.magazine ORDER BY r.article) AS n FROM r JOIN p ON p.article = r.article AND p.magazine <> r.magazine)
    SELECT article, magazine, section, CAST(display_order AS BIGINT) AS display_order FROM t
    UNION ALL SELECT article, magazine, section, coalesce((SELECT max(display_order) FROM t WHERE t.magazine = f.magazine), -1) + n FROM f""")
def magazine_moves(spark: SparkSession, d: str) -> DataFrame:
    """Published articles go to a magazine, half of them to another than they are in; those in review are taken out."""
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'O'")
    wanted = F.when(F.col("o_orderstatus") == "F", (F.col("o_custkey") + F.col("o_orderkey") % 2) % 100)
    requests = orders.select(F.col("o_orderkey").alias("article"), wanted.alias("magazine"), F.lit("S").alias("section"), (F.col("o_orderkey") % 3 == 0).alias("section_given"))
    return E.reconciled(_placed(spark, d), requests)


@query(_PLACED_SQL + """
    , e AS (SELECT o_orderkey AS article, CASE WHEN o_orderkey % 500 = 1 THEN o_custkey + 1 ELSE o_custkey END % 100 AS magazine, 100 + o_orderkey % 9 AS place FROM orders WHERE o_orderstatus = 'P'),
    b AS (SELECT DISTINCT magazine FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.article = e.article AND p.magazine = e.magazine))
    SELECT p.magazine, p.article, coalesce(place, display_order) AS display_order FROM p LEFT JOIN (SELECT * FROM e WHERE magazine NOT IN (SELECT magazine FROM b)) e ON e.article = p.article AND e.magazine = p.magazine""")
def magazine_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Some magazines' entries name an article of another, so these magazines stay as they are."""
    magazine = F.when(F.col("o_orderkey") % 500 == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")) % 100
    entries = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(magazine.alias("magazine"), F.col("o_orderkey").alias("article"), (100 + F.col("o_orderkey") % 9).alias("display_order"))
    return E.reordered(_placed(spark, d), entries).select("magazine", "article", "display_order")


@query("""
    WITH c AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
    SELECT doc_id AS term, coalesce(n, 0) AS uses, CASE WHEN n > 0 THEN 'IN_USE' END AS code, n IS NULL AS deleted FROM documents LEFT JOIN c USING (doc_id)""")
def term_deletion(spark: SparkSession, d: str) -> DataFrame:
    out = E.delete_unreferenced(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return out.select(F.col("doc_id").alias("term"), F.col("references").alias("uses"), "code", "deleted")


@query("""
    SELECT event_id AS comment, CASE WHEN o_orderkey IS NULL THEN 'ARTICLE_NOT_PUBLISHED' END AS create_code, CASE WHEN event_id % 2 = 1 AND event_type <> 'signup' THEN 'NOT_YOUR_COMMENT' END AS delete_code,
    CASE WHEN event_id % 4 = 0 AND event_type = 'view' THEN 'CANNOT_SELF_DEMOTE' WHEN event_id % 4 = 0 AND event_type = 'click' THEN 'CANNOT_SELF_DEACTIVATE' END AS user_code
    FROM events LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = event_id""")
def comment_and_user_commands(spark: SparkSession, d: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    published = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    rows = table(spark, d, "events").join(published, F.col("o_orderkey") == n, "left")
    role = F.when(kind == "signup", "ADMIN").otherwise("USER")
    update = E.user_update_code(n % 4, F.lit(0), F.when(kind == "view", "USER").when(kind == "click", "ADMIN"), F.when(kind == "click", F.lit(False)))
    return rows.select(n.alias("comment"), F.when(F.col("o_orderkey").isNull(), "ARTICLE_NOT_PUBLISHED").alias("create_code"), E.deletion_code(n, n + n % 2, role).alias("delete_code"), update.alias("user_code"))


@query("""
    WITH now AS (SELECT max(ts) - INTERVAL 10 DAY AS now FROM events), c AS (SELECT user_id, event_id, CAST(event_id % 3 AS VARCHAR) AS code, ts + to_days(CAST(event_id % 30 AS INT)) AS expires, event_id % 7 AS attempts, ts FROM events WHERE event_type <> 'view'),
    a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    t AS (SELECT u.user_id, c_acctbal < 0 AS verified, event_id, code, expires, attempts, CAST(u.user_id % 3 AS VARCHAR) AS entered, now FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN customer ON c_custkey = u.user_id LEFT JOIN a ON a.user_id = u.user_id, now)
    SELECT user_id, event_id AS code_id, CASE WHEN verified IS NULL THEN 'INVALID_OTP' WHEN verified THEN 'ALREADY_VERIFIED' WHEN event_id IS NULL OR expires < now THEN 'INVALID_OTP' WHEN attempts >= 5 THEN 'OTP_ATTEMPTS_EXCEEDED' WHEN code = entered THEN 'OK' ELSE 'INVALID_OTP' END AS result,
    attempts + CASE WHEN NOT verified AND expires >= now AND attempts < 5 AND code <> entered THEN 1 ELSE 0 END AS attempts FROM t""")
def one_time_codes(spark: SparkSession, d: str) -> DataFrame:
    """Each user enters a code ten days before the last event; views stand for codes that were used."""
    events, n = table(spark, d, "events"), F.col("event_id")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("now")).scalar()
    expires = F.expr("ts + make_dt_interval(cast(event_id % 30 as int))")
    codes = events.select("user_id", n.alias("code_id"), (n % 3).cast("string").alias("code"), F.col("ts").alias("created"), expires.alias("expires"), (n % 7).alias("attempts"), (F.col("event_type") == "view").alias("consumed"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("verified"))
    return E.verified(events.select("user_id", (F.col("user_id") % 3).cast("string").alias("entered")).distinct(), users, codes, now)


@query("""
    SELECT source, count(*) AS pages, CAST(sum(length(regexp_replace(left(coalesce(text, ''), doc_id % 240), '[\\s\\x0B\\x{85}\\p{Z}]', '', 'g'))) AS BIGINT) AS chars,
    sum(length(regexp_replace(left(coalesce(text, ''), doc_id % 240), '[\\s\\x0B\\x{85}\\p{Z}]', '', 'g'))) / count(*) < 100 AS needs_ocr FROM documents GROUP BY source""")
def pages_without_text(spark: SparkSession, d: str) -> DataFrame:
    """A scan's text layer is short: of each page some first characters stand for it."""
    pages = table(spark, d, "documents").select("source", F.expr("left(text, cast(doc_id % 240 as int))").alias("text"))
    return G.needs_ocr(pages, "source", "text")


@query(f"""
    WITH b AS (SELECT conv_id, turn, turn % 2 = 0 AS image, lead(turn) OVER w % 2 = 1 AS para, {_TRIM_SQL.format("lead(left(text, CAST(60 + 30 * turn AS INT))) OVER w")} AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN para AND length(t) BETWEEN 1 AND 160 AND regexp_matches(t, '^[\\p{{Lu}}\\p{{N}}"“(]') AND NOT (regexp_matches(t, '[.!?]$') AND len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) > 20) THEN t END AS caption FROM b WHERE image""")
def image_captions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("turn") % 2 == 0, "image").otherwise("paragraph")
    blocks = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), F.expr("left(text, cast(60 + 30 * turn as int))").alias("text"))
    return G.captions(blocks, "conv_id", "turn", "kind", "text")


@query("""
    WITH r AS (SELECT conv_id, turn AS id, turn // 2 + turn % 3 AS s, turn + turn % 4 - 1 AS e FROM conversations WHERE role <> 'system'), p AS (SELECT conv_id, turn - turn % 2 AS place FROM conversations)
    SELECT conv_id, place, (SELECT arg_min(id, 1000000 * s + id) FROM r WHERE r.conv_id = p.conv_id AND place BETWEEN s AND e) AS range_id FROM p""")
def containing_ranges(spark: SparkSession, d: str) -> DataFrame:
    turns, n = table(spark, d, "conversations"), F.col("turn")
    ranges = turns.filter("role <> 'system'").select("conv_id", n.alias("range_id"), (F.floor(n / 2) + n % 3).alias("start"), (n + n % 4 - 1).alias("end"))
    return G.containing(turns.select("conv_id", (n - n % 2).alias("place")), ranges, "conv_id", "place")


@query("""
    WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(strip_accents(split_part(coalesce(text, ''), chr(10), 1))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS word FROM documents)
    SELECT min(doc_id) AS doc_id, word FROM w GROUP BY word HAVING count(*) = 1""")
def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    return G.distinctive(table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("title")), "doc_id", "title")


@query("""
    WITH f AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS ref, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, ref, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM f""")
def references_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("ref"), "event_id")
    return G.first_seen(rows, "user_id", "ref", ["event_id"])


@query(f"""
    SELECT c_custkey AS user_id, c_name || '.' || sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(c_name)))) AS token, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS verified FROM customer""")
def unsubscribe_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Of three tokens one comes back as it was, one with something behind it, one under another name."""
    token, of = G.signed(F.col("c_name"), SECRET), F.col("c_custkey") % 3
    back = F.when(of == 0, token).when(of == 1, F.concat(token, F.lit("0"))).otherwise(F.concat(F.lit("x"), token))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), token.alias("token"), G.signer(back, SECRET).alias("verified"))


@query("""
    SELECT page_id, trim(regexp_replace(lower(coalesce(string_split(url, '/')[-2], '') || '--' || regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '-', 'g'), '-') AS issue,
    'page-' || CASE WHEN page_id < 100 THEN lpad(CAST(page_id AS VARCHAR), 3, '0') ELSE CAST(page_id AS VARCHAR) END AS file FROM pages""")
def issue_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", G.issue_key(F.col("url")).alias("issue"), G.page_file(F.col("page_id")).alias("file"))
