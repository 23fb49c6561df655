"""Named queries of sessions and limiters, each beside its SQL. Events stand for what users do with refresh tokens, which are named by the event that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.plans.registry import query
from marginalia.sources.tables import table
from marginalia.streaming import sessions as S
from marginalia.streaming import stateful as Z

LIFE_US = 10 * 24 * 3_600_000_000

_EVENTS_SQL = """
    e AS (SELECT user_id, epoch_us(ts) AS us, event_id AS seq, row_number() OVER w AS k, event_type AS type, CASE WHEN event_id % 23 = 0 THEN lag(event_id, 3) OVER w ELSE lag(event_id) OVER w END AS before FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    v AS (SELECT *, CASE WHEN seq % 61 = 0 THEN 'deactivate' WHEN type IN ('purchase', 'signup') OR k = 1 THEN 'issue' WHEN type = 'error' THEN 'logout' ELSE 'refresh' END AS kind FROM e)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and signups begin a session, views and clicks refresh the token of the user's event before, in one case of 23 of an older one; errors are logouts."""
    n = F.col("event_id")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").filter("user_id IS NOT NULL").withColumns({"k": F.row_number().over(own), "one": F.lag(n).over(own), "three": F.lag(n, 3).over(own)})
    kind = F.when(n % 61 == 0, "deactivate").when(F.col("event_type").isin("purchase", "signup") | (F.col("k") == 1), "issue").when(F.col("event_type") == "error", "logout").otherwise("refresh")
    before = F.when(n % 23 == 0, F.col("three")).otherwise(F.col("one")).cast("string")
    token = F.when(kind == "issue", n.cast("string")).otherwise(before)
    return rows.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), n.alias("seq"), kind.alias("kind"), token.alias("token"), n.cast("string").alias("new_token"))


@query(f"""
    WITH RECURSIVE {_EVENTS_SQL},
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, true AS active, []::STRUCT(t BIGINT, e BIGINT)[] AS live, []::BIGINT[] AS gone, 0::BIGINT AS us, 0::BIGINT AS seq, '' AS kind, NULL::BIGINT AS token, NULL::VARCHAR AS result, 0::BIGINT AS revoked FROM v
    UNION ALL SELECT user_id, k, active AND kind <> 'deactivate',
      CASE WHEN kind = 'issue' AND active THEN list_append(live, {{t: seq, e: us + {LIFE_US}}}) WHEN result = 'REFRESH_TOKEN_REUSED' THEN []
        WHEN kind = 'refresh' AND result = 'OK' THEN list_append(list_filter(live, lambda x: x.t <> before), {{t: seq, e: us + {LIFE_US}}}) WHEN kind = 'logout' OR (kind = 'refresh' AND valid) THEN list_filter(live, lambda x: x.t IS DISTINCT FROM before) ELSE live END,
      CASE WHEN result = 'REFRESH_TOKEN_REUSED' THEN list_concat(gone, list_transform(live, lambda x: x.t)) WHEN held AND (kind = 'logout' OR valid) AND kind IN ('logout', 'refresh') THEN list_append(gone, before) ELSE gone END,
      us, seq, kind, CASE WHEN kind = 'issue' THEN seq ELSE before END, result,
      CASE WHEN result = 'REFRESH_TOKEN_REUSED' THEN len(live) WHEN held AND (kind = 'logout' OR (kind = 'refresh' AND valid)) THEN 1 ELSE 0 END
    FROM (SELECT *, CASE WHEN kind = 'issue' THEN CASE WHEN active THEN 'OK' ELSE 'ACCOUNT_DEACTIVATED' END WHEN kind IN ('logout', 'deactivate') THEN 'OK' WHEN used THEN 'REFRESH_TOKEN_REUSED' WHEN valid AND active THEN 'OK' ELSE 'INVALID_REFRESH_TOKEN' END AS result
      FROM (SELECT v.user_id, v.k, v.us, v.seq, v.kind, v.before, s.active, s.live, s.gone, coalesce(list_contains(s.gone, v.before), false) AS used, len(list_filter(s.live, lambda x: x.t = v.before)) > 0 AS held, len(list_filter(s.live, lambda x: x.t = v.before AND x.e >= v.us)) > 0 AS valid
        FROM s JOIN v ON v.user_id = s.user_id AND v.k = s.k + 1)))
    SELECT user_id, us AS "at", seq, kind, token::VARCHAR AS token, result, revoked FROM s WHERE k > 0""")
def session_rotation(spark: SparkSession, d: str) -> DataFrame:
    return S.rotated(_events(spark, d), LIFE_US)


_RULES = ", ".join(f"('{route}', {most}, {window})" for route, most, window in S.limiter_rules())


@query(f"""
    WITH RECURSIVE h AS (SELECT user_id, ['register', 'login', 'verify', 'resend'][1 + event_id % 4] AS route, epoch_us(ts) // 40 AS us, event_id AS seq FROM events WHERE user_id IS NOT NULL),
    r AS (SELECT * FROM (VALUES {_RULES}) t(route, most, span)),
    n AS (SELECT h.*, most, span, row_number() OVER (PARTITION BY user_id, route, most ORDER BY us, seq) AS k FROM h JOIN r USING (route)),
    s AS (SELECT *, us AS opened, 1::BIGINT AS hits FROM n WHERE k = 1
    UNION ALL SELECT n.*, CASE WHEN n.us - s.opened >= n.span THEN n.us ELSE s.opened END, CASE WHEN n.us - s.opened >= n.span THEN 1 ELSE s.hits + 1 END FROM s JOIN n ON n.user_id = s.user_id AND n.route = s.route AND n.most = s.most AND n.k = s.k + 1)
    SELECT seq AS event_id, route, bool_and(hits <= most) AS allowed FROM s GROUP BY seq, route""")
def auth_limiters(spark: SparkSession, d: str) -> DataFrame:
    """Each route's hits of a user pass all limiters of the route, each with windows of its own; times are taken forty times as dense."""
    routes = F.array(*(F.lit(x) for x in ("register", "login", "verify", "resend")))
    hits = table(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", F.get(routes, (F.col("event_id") % 4).cast("int")).alias("route"), F.col("event_id").alias("id"), F.expr("unix_micros(cast(ts AS timestamp)) div 40").alias("at"))
    out = None
    for most, window in sorted({(most, window) for _, most, window in S.limiter_rules()}):
        own = hits.filter(F.col("route").isin([route for route, m, w in S.limiter_rules() if (m, w) == (most, window)])).select(F.concat_ws("/", F.col("user_id").cast("string"), "route").alias("key"), "id", "at")
        done = Z.limited(own, window, most)
        out = done if out is None else out.unionByName(done)
    return out.groupBy(F.col("id").alias("event_id"), F.split_part("key", F.lit("/"), F.lit(2)).alias("route")).agg(F.bool_and("allowed").alias("allowed"))
