"""Editorial commands on versions as rewrites of all tables that they touch, from one table of decided commands.

articles: article, owner, status, published and pending (numbers of versions), published_at, and the snapshot ``fields``. versions: article, version, status, created_by, minutes,
and the fields, of which content_mode and pdf_pages are two. blocks: article, version, position, kind, content (JSON). commands: seq, article, command, actor, role, payload (a struct of the
fields, null where the command has none). payload_blocks: seq, position, kind, content.

Commands: save (the editable version gets payload and blocks), revise (the published version is copied to a new draft), edit_published (a new version of the payload is published at once),
approve (the submitted version is published), publish (the pending version is, submitted or not).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import blocks as B
from marginalia.sources.scratch import written

ADMIN_COMMANDS = ("approve", "publish", "edit_published")
EDITABLE = ("DRAFT", "REJECTED")


class Tables(NamedTuple):
    decided: DataFrame  #: the commands with code (null: accepted) and version, the one that each is about
    articles: DataFrame
    versions: DataFrame
    blocks: DataFrame
    reviews: DataFrame  #: article, version, actor, action
    notices: DataFrame  #: article, kind: article_published goes to readers, article_approved to user_id


def _code() -> Column:
    """Why a command is refused: the first rule that it breaks; null if it breaks none."""
    c, pending, published, state = F.col("command"), F.col("pending"), F.col("published"), F.col("_state")
    stranger = ~F.coalesce(F.col("owner") == F.col("actor"), F.lit(False))
    admin = F.coalesce(F.col("role") == "ADMIN", F.lit(False))
    known = ("save", "revise", *ADMIN_COMMANDS)
    return (
        F.when(F.col("_turn") > 1, "CONFLICT")
        .when(F.col("owner").isNull() & F.col("_missing"), "NOT_FOUND")
        .when(~F.coalesce(c.isin(*known), F.lit(False)), "UNKNOWN_COMMAND")
        .when(c.isin(*ADMIN_COMMANDS) & ~admin, "FORBIDDEN")
        .when(((c == "revise") | ((c == "save") & ~admin)) & stranger, "NOT_FOUND")
        .when((c == "save") & pending.isNull(), "NO_EDITABLE_VERSION")
        .when(c.isin("approve", "publish") & pending.isNull(), "NO_PENDING_VERSION")
        .when(c.isin("revise", "edit_published") & published.isNull(), "NOT_PUBLISHED")
        .when(c.isin("revise", "edit_published") & pending.isNotNull(), "REVISION_IN_PROGRESS")
        .when((c != "edit_published") & state.isNull(), "NOT_FOUND")
        .when((c == "save") & ~state.isin(*EDITABLE), "VERSION_NOT_EDITABLE")
        .when((c == "approve") & (state != "PENDING_REVIEW"), "NOT_PENDING_REVIEW")
    )


def _decided(commands: DataFrame, articles: DataFrame, versions: DataFrame, payload_blocks: DataFrame, fields: list[str]) -> DataFrame:
    """The commands with code, version, the article's pointers, the content that they put in place, and its reading minutes."""
    turn = F.row_number().over(Window.partitionBy("article").orderBy("seq"))
    known = articles.select("article", "owner", "published", "pending", F.lit(False).alias("_there"))
    counts = versions.groupBy("article").agg(F.count(F.lit(1)).alias("_count"))
    rows = commands.withColumn("_turn", turn).join(known, "article", "left").join(counts, "article", "left").withColumn("_missing", F.col("_there").isNull())
    source = F.when(F.col("command") == "revise", F.col("published")).otherwise(F.col("pending"))
    own = versions.select("article", F.col("version").alias("_source"), F.col("status").alias("_state"), F.col("minutes").alias("_minutes"), F.struct(*fields).alias("_old"))
    rows = rows.withColumn("_source", source).join(own, ["article", "_source"], "left").withColumn("code", _code())
    words = payload_blocks.withColumn("_words", B.block_words()).groupBy("seq").agg(F.sum("_words").alias("_words"))
    rows = rows.join(words, "seq", "left")
    given = F.col("command").isin("save", "edit_published")
    pages = F.col("payload.pdf_pages")
    counted = F.when(F.col("payload.content_mode") == "PDF", B.minutes_of_pages(F.coalesce(pages, F.lit(0)))).otherwise(B.reading_minutes(F.coalesce("_words", F.lit(0))))
    fresh = F.col("command").isin("revise", "edit_published")
    return rows.select(
        "seq", "article", "command", "actor", "code", F.when(F.col("code").isNull(), F.when(fresh, F.coalesce("_count", F.lit(0)) + 1).otherwise(F.col("pending"))).alias("version"),
        "owner", "published", F.when(given, F.col("payload")).otherwise(F.col("_old")).alias("_new"), F.when(given, counted).otherwise(F.col("_minutes")).alias("_minutes"),
    )


def applied(commands: DataFrame, payload_blocks: DataFrame, articles: DataFrame, versions: DataFrame, blocks: DataFrame, fields: list[str], now: Column) -> Tables:
    """All tables after the commands. Of several commands of a batch for an article the first by seq is taken, the others are refused; seq is unique.

    A new version has the number of the article's versions and one. What is published takes the place of the version published before, which is superseded, and the article takes over
    its fields; a save does so only while nothing is published. Refused commands change nothing. ``now`` is a parameter, so that a run can be repeated.

    At scale: each table is joined to the accepted commands once, by its key; the decided commands are written once, as every table needs them.
    """
    decided = written(_decided(commands, articles, versions, payload_blocks, fields), "decided")
    good = decided.filter("code IS NULL")
    publishes = F.col("_command").isin(*ADMIN_COMMANDS)
    mine = good.select("article", F.col("command").alias("_command"), F.col("actor").alias("_actor"), F.col("version").alias("_version"), F.col("published").alias("_before"), "_new", "_minutes")

    put = F.col("_command").isNotNull() & (publishes | ((F.col("_command") == "save") & F.col("published").isNull()))
    new = {f: F.when(put, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    live = F.coalesce(publishes, F.lit(False))
    rows = articles.join(mine, "article", "left").withColumns(new)
    rows = rows.withColumns({
        "pending": F.when(live, F.lit(None)).when(F.col("_command") == "revise", F.col("_version")).otherwise(F.col("pending")),
        "published": F.when(live, F.col("_version")).otherwise(F.col("published")),
        "status": F.when(live, "PUBLISHED").otherwise(F.col("status")), "published_at": F.when(live, now).otherwise(F.col("published_at")),
    })
    out_articles = rows.select(*articles.columns)

    rows = versions.join(mine, "article", "left")
    own = F.coalesce(F.col("version") == F.col("_version"), F.lit(False))
    saved = own & (F.col("_command") == "save")
    status = F.when(own & live, "PUBLISHED").when(live & (F.col("version") == F.col("_before")), "SUPERSEDED").otherwise(F.col("status"))
    kept = rows.withColumns({"status": status, "minutes": F.when(saved, F.col("_minutes")).otherwise(F.col("minutes")), **{f: F.when(saved, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}})
    fresh = mine.filter("_command IN ('revise', 'edit_published')").select(
        "article", F.col("_version").alias("version"), F.when(F.col("_command") == "revise", "DRAFT").otherwise("PUBLISHED").alias("status"), F.col("_actor").alias("created_by"), F.col("_minutes").alias("minutes"), "_new.*"
    )
    out_versions = kept.select(*versions.columns).unionByName(fresh.select(*versions.columns))

    stays = blocks.join(good.filter("command = 'save'").select("article", "version"), ["article", "version"], "left_anti")
    given = good.filter("command IN ('save', 'edit_published')").select("seq", "article", "version").join(payload_blocks, "seq").drop("seq")
    source = good.filter("command = 'revise'").select("article", F.col("published").alias("version"), F.col("version").alias("_version"))
    copies = blocks.join(source, ["article", "version"]).withColumn("version", F.col("_version"))
    out_blocks = stays.select(*blocks.columns).unionByName(given.select(*blocks.columns)).unionByName(copies.select(*blocks.columns))

    done = good.filter(F.col("command").isin(*ADMIN_COMMANDS))
    reviews = done.select("article", "version", "actor", F.when(F.col("command") == "approve", "APPROVED").otherwise("PUBLISHED_DIRECT").alias("action"))
    first = done.filter("published IS NULL")
    told = first.select("article", F.lit("article_published").alias("kind"), F.lit(None).cast(articles.schema["owner"].dataType).alias("user_id"))
    thanked = first.filter(~F.col("owner").eqNullSafe(F.col("actor"))).select("article", F.lit("article_approved").alias("kind"), F.col("owner").alias("user_id"))
    return Tables(decided.select("seq", "article", "command", "code", "version"), out_articles, out_versions, out_blocks, reviews, told.unionByName(thanked))
