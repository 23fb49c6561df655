"""Editorial commands as rewrites of whole tables: every operator returns the tables as they are after the commands.

Commands come in batches, one row a command; what a rule refuses changes nothing. Only checks, guards and one-time codes say why, by a code; so do the commands of ``operators.versions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: The most characters of a version's fields.
VERSION_LIMITS = {"title": 300, "subtitle": 400, "summary": 2000, "author_name": 200, "author_bio": 2000}
MOST_PAGES = 2000
#: The most bytes of an upload by its type.
UPLOAD_LIMITS = {"image/jpeg": 10 << 20, "image/png": 10 << 20, "image/webp": 10 << 20, "image/gif": 10 << 20, "application/pdf": 25 << 20}


def _blank(c: str | Column) -> Column:
    return F.coalesce(T.tidy_ends(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def missing_to_submit() -> Column:
    """Names of the fields that a version (title, summary, author_name, category, content_mode, pdf_media, blocks: how many) lacks for
    review, in this order; empty if it's ready."""
    lacks = [F.when(_blank(c), F.lit(c)) for c in ("title", "summary", "author_name")]
    pdf = F.coalesce(F.col("content_mode") == "PDF", F.lit(False))
    lacks += [F.when(F.col("category").isNull(), F.lit("category")), F.when(pdf & F.col("pdf_media").isNull(), F.lit("pdf_media")), F.when(~pdf & (F.coalesce("blocks", F.lit(0)) == 0), F.lit("blocks"))]
    return F.array_compact(F.array(*lacks))


def parsed_versions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, the declared fields as they are stored (trimmed, with the default mode; others are dropped), and errors: one per field."""
    trimmed = {c: T.tidy_ends(F.col(c)) for c in VERSION_LIMITS}
    mode = F.coalesce("content_mode", F.lit("BLOCKS"))
    found = [F.when(_blank(c), F.lit(f"{c}: required")) for c in ("title", "author_name")]
    found += [F.when(F.length(trimmed[c]) > n, F.lit(f"{c}: too long")) for c, n in VERSION_LIMITS.items()]
    found += [
        F.when(~F.coalesce(F.col("category").rlike(UUID), F.lit(False)), F.lit("category: not a uuid")),
        F.when(~mode.isin("BLOCKS", "PDF"), F.lit("content_mode: unknown")),
        F.when((mode == "PDF") & F.col("pdf_media").isNull(), F.lit("pdf_media: required")),
        F.when(~F.col("pdf_media").rlike(UUID), F.lit("pdf_media: not a uuid")),
        F.when(~F.col("pdf_pages").between(1, MOST_PAGES), F.lit("pdf_pages: out of range")),
    ]
    return df.select(*keys, *(v.alias(k) for k, v in trimmed.items()), "category", mode.alias("content_mode"), "pdf_media", "pdf_pages", F.array_compact(F.array(*found)).alias("errors"))


def upload_code(kind: Column, size: Column) -> Column:
    """FILE_TOO_LARGE, UNSUPPORTED_FILE_TYPE or null."""
    limits = F.create_map(*[F.lit(x) for k, v in UPLOAD_LIMITS.items() for x in (k, v)])
    limit = F.try_element_at(limits, F.coalesce(kind, F.lit("")))
    return F.when(limit.isNull(), "UNSUPPORTED_FILE_TYPE").when(size > limit, "FILE_TOO_LARGE")


def media_references(media: DataFrame, key: str, counters: dict[str, list[DataFrame]]) -> DataFrame:
    """Media with a count for each counter. A counter's tables have the column ``key``, one row a reference; null refers to nothing.

    All tables are counted in one aggregation with partial sums, whatever their number; media without references have 0.
    """
    rows = [r.select(F.col(key), F.lit(name).alias("_counter")) for name, tables in counters.items() for r in tables]
    refs = rows[0]
    for more in rows[1:]:
        refs = refs.unionByName(more)
    sums = refs.groupBy(key).agg(*(F.count_if(F.col("_counter") == n).alias(n) for n in counters))
    out = media.join(sums, key, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counters})


def use_reason(labels: dict[str, str]) -> Column:
    """Why a medium can't be deleted, by its counters and what they are called; null if it can."""
    parts = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label} use(s)"))) for c, label in labels.items())))
    return F.when(F.size(parts) > 0, F.concat(F.lit("Still in use — "), F.array_join(parts, ", ")))


def with_media_urls(blocks: DataFrame, media: DataFrame) -> DataFrame:
    """Blocks (content: map of strings) with the url of their mediaId, null if it has none; blocks without a mediaId stay as they are.
    ``media``: media_id (unique), url."""
    own = F.try_element_at("content", F.lit("mediaId"))
    found = blocks.withColumn("_media", own).join(media.select(F.col("media_id").alias("_media"), F.col("url").alias("_url")), "_media", "left")
    rest = F.map_filter("content", lambda k, v: k != "url")
    return found.withColumn("content", F.when(F.coalesce(F.col("_media"), F.lit("")) != "", F.map_concat(rest, F.create_map(F.lit("url"), F.col("_url")))).otherwise(F.col("content"))).select(*blocks.columns)


def promoted(articles: DataFrame, versions: DataFrame, snapshot: list[str], direct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Articles (article, published, pending and the snapshot fields) and versions (article, version, status and those fields) after
    the pending version of each article is published: one that was submitted for review, or any if ``direct``. The version it replaces is superseded; the article takes over the fields.
    ``first_publish`` says whether readers are told. Articles without such a version stay as they are, also if the one that they point to doesn't exist.
    ``operators.versions`` has the same as a command, with refusals and a record of it."""
    ready = F.lit(True) if direct else F.col("status") == "PENDING_REVIEW"
    new = versions.filter(ready).select("article", F.col("version").alias("pending"), F.struct(*snapshot).alias("_new"))
    rows = articles.join(new, ["article", "pending"], "left").withColumn("_go", F.col("_new").isNotNull())
    pointers = rows.filter("_go").select("article", F.col("published").alias("_published"), F.col("pending").alias("_pending"))
    marked = versions.join(pointers, "article", "left")
    status = F.when(F.col("version") == F.col("_pending"), "PUBLISHED").when(F.col("version") == F.col("_published"), "SUPERSEDED").otherwise(F.col("status"))
    marked = marked.withColumn("status", status).select(*versions.columns)
    rows = rows.withColumn("first_publish", F.col("_go") & F.col("published").isNull())
    rows = rows.withColumns({c: F.when(F.col("_go"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in snapshot})
    rows = rows.withColumn("published", F.when(F.col("_go"), F.col("pending")).otherwise(F.col("published"))).withColumn("pending", F.when(~F.col("_go"), F.col("pending")))
    return rows.select(*articles.columns, "first_publish"), marked


def reconciled(placements: DataFrame, requests: DataFrame) -> DataFrame:
    """Placements (article, magazine, section, display_order; an article has one at most) after requests (article, magazine, section,
    section_given), one for an article. A null magazine takes the article out; its own magazine keeps the place, with the section if one
    is given; another one takes it at the end, in the order of articles. Articles without a request stay."""
    old = placements.select("article", F.col("magazine").alias("_old"), F.col("section").alias("_section"), F.col("display_order").alias("_order"))
    asked = requests.filter("magazine IS NOT NULL").join(old, "article", "left")
    same = F.coalesce(F.col("_old") == F.col("magazine"), F.lit(False))
    stays = placements.join(requests.select("article"), "article", "left_anti")
    kept = asked.filter(same).select("article", "magazine", F.when(F.col("section_given"), F.col("section")).otherwise(F.col("_section")).alias("section"), F.col("_order").alias("display_order"))
    # those that leave free no place for the next: the end is that of what stays and what is kept
    there = stays.select("article", "magazine", "section", "display_order").unionByName(kept)
    ends = there.groupBy("magazine").agg(F.max("display_order").alias("_end"))
    rank = F.row_number().over(Window.partitionBy("magazine").orderBy("article"))
    fresh = asked.filter(~same).withColumn("_rank", rank).join(ends, "magazine", "left")
    fresh = fresh.select("article", "magazine", F.when(F.col("section_given"), F.col("section")).alias("section"), (F.coalesce("_end", F.lit(-1)) + F.col("_rank")).cast(placements.schema["display_order"].dataType).alias("display_order"))
    return there.unionByName(fresh)


def reordered(placements: DataFrame, entries: DataFrame) -> DataFrame:
    """Placements (magazine, article, display_order) after entries of the same columns, unique by magazine and article. A magazine's
    entries are taken over together, or none of them if one of its articles isn't placed there."""
    keys = ["magazine", "article"]
    refused = entries.join(placements.select(*keys), keys, "left_anti").select("magazine").distinct()
    good = entries.join(refused, "magazine", "left_anti").select(*keys, F.col("display_order").alias("_new"))
    return placements.join(good, keys, "left").withColumn("display_order", F.coalesce("_new", "display_order")).select(*placements.columns)


def delete_unreferenced(terms: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Terms with references, code (IN_USE or null) and deleted: only what nothing refers to can be deleted."""
    counts = references.groupBy(key).agg(F.count(F.lit(1)).alias("references"))
    out = terms.join(counts, key, "left").withColumn("references", F.coalesce("references", F.lit(0)))
    return out.withColumn("code", F.when(F.col("references") > 0, "IN_USE")).withColumn("deleted", F.col("code").isNull())


def deletion_code(owner: Column, actor: Column, role: Column) -> Column:
    """A comment's author or an admin may delete it."""
    return F.when(~(F.coalesce(owner == actor, F.lit(False)) | F.coalesce(role == "ADMIN", F.lit(False))), "NOT_YOUR_COMMENT")


def user_update_code(actor: Column, target: Column, role: Column, active: Column) -> Column:
    """No admin locks themselves out. Null role or state: no change asked."""
    own = actor == target
    return F.when(own & (role != "ADMIN"), "CANNOT_SELF_DEMOTE").when(own & ~active, "CANNOT_SELF_DEACTIVATE")


def verified(tries: DataFrame, users: DataFrame, codes: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """tries: user_id, entered (one for a user); users: user_id, verified; codes: user_id, code_id, code, created, expires, attempts,
    consumed. Per try: result (OK or a code), code_id and its attempts afterwards. The newest code that isn't consumed counts; its expiry comes before
    its attempts, and a wrong entry is one more. ``now`` is a parameter, so that a run can be repeated."""
    active = codes.filter(~F.col("consumed")).groupBy("user_id").agg(F.max_by(F.struct("code_id", "code", "expires", "attempts"), F.struct("created", "code_id")).alias("_code"))
    out = tries.join(users, "user_id", "left").join(active, "user_id", "left")
    code = F.col("_code")
    right = F.coalesce(F.col("entered") == code.code, F.lit(False))
    result = (
        F.when(F.col("verified").isNull(), "INVALID_OTP").when(F.col("verified"), "ALREADY_VERIFIED").when(code.isNull() | (code.expires < now), "INVALID_OTP")
        .when(code.attempts >= most, "OTP_ATTEMPTS_EXCEEDED").when(right, "OK").otherwise("INVALID_OTP")
    )
    counted = ~F.col("verified") & (code.expires >= now) & (code.attempts < most) & ~right
    return out.select("user_id", result.alias("result"), code.code_id.alias("code_id"), (code.attempts + F.when(counted, 1).otherwise(0)).alias("attempts"))
