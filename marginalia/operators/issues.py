"""Titles, bylines, openings and blocks of an issue, as expressions and windows over its pages or blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: What a page carries that is no title, words that no title ends with, straps that no title holds inside.
FURNITURE = (r"^volume\s+[ivx0-9]", r"^issue\b", r"^contents?$", r"^news vistas", r"^(figure|fig\.|table|chart|source:|photo)\b", r"^(cover story|cover article|feature article|feature story|tutorial|consumers? desk|about)$")
DANGLING = "and|or|but|the|of|in|to|for|with|from|at|on|by|is|are|a|an|that|which"
INNER_STRAPS = r"\S\s+(cover (story|article)|feature (article|story)|consumers? desk|tutorial|editorial)\b"
#: Words that a headline in mixed case keeps small.
SMALL_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor", "of", "on", "onto", "or", "over", "the", "to", "up", "via", "with",
]
#: What opens a byline, words that no name has, the form of a byline in running text, the label of a synopsis.
BYLINE_PREFIX = r"^[-‐–—]\s*|^(by|mr|mrs|ms|dr|prof|er)\.?\s+"
NOT_A_NAME = r"\b(the|of|and|for|in|on|to|a|an|with|from|through|its|is|are|be|by|at|as|our|new|power|energy|electricity|solar|grid|india|indian|these|this|that)\b"
BYLINE = r"^(?:by\s+)?((?:(?:Mr|Mrs|Ms|Dr|Prof|Er)\.?\s+)?\p{Lu}[\p{L}.'-]*(?:\s+\p{Lu}[\p{L}.'-]*){1,3})(?:\s*,\s*[\p{L}\s.&'-]{2,40})?$"
SYNOPSIS = r"^synopsis\s*\d*$"
FRONT_MATTER = "About"
DEFAULT_STRAP = "Feature Article"


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries that letters beyond ASCII make too: the rules are stated for words of ASCII."""
    return pattern.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")


def garbled(title: Column, furniture: Iterable[str] = FURNITURE) -> Column:
    """Whether a title can't be one: too short or long, page furniture, a slice of a sentence, or two texts read as one. Null is."""
    text = T.tidy_ends(T.expand_ligatures(F.coalesce(title, F.lit(""))))
    words, letters = F.split(text, r"\s+"), F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))
    twins = F.length(letters) - F.length(F.regexp_replace(letters, r"(.)\1+", "$1"))
    signs = [
        F.length(text) < 8,
        *(text.rlike(f"(?i){ascii_words(x)}") for x in furniture),
        text.rlike("^[a-z]"),
        text.rlike(ascii_words(rf"(?i)\b({DANGLING})$")),
        (F.length(text) > 140) | (F.size(words) > 22),
        (F.length(letters) >= 10) & (twins * 5 > F.length(letters) * 2),
        F.exists(words, lambda w: (F.length(w) > 16) | ((F.length(w) > 10) & w.rlike("[a-z][A-Z]"))),
        (F.size(words) >= 8) & F.exists(F.slice(words, 2, 200), lambda w: w.rlike("^[0-9]{2,3}$")),
        text.rlike(f"(?i){ascii_words(INNER_STRAPS)}"),
    ]
    out = signs[0]
    for sign in signs[1:]:
        out = out | sign
    return out


def title_case(title: Column, acronyms: Iterable[str], small: Iterable[str] = SMALL_WORDS) -> Column:
    """A headline in capitals with a capital at the start of each word only, small words but at its ends left small, acronyms whole.
    One with more than a fifth of its letters in lower case stays as it is, trimmed. Null stays null."""
    text = T.tidy_ends(title)
    low, up = F.regexp_count(text, F.lit("[a-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\s–—/-]|[^\s–—/-]+"), F.lit(0))

    def cased(token: Column, i: Column) -> Column:
        bare = F.regexp_replace(token, "[^a-z0-9&]", "")
        lead = F.length(F.regexp_extract(token, "^[^a-z]*", 0))
        capital = F.concat(F.substring(token, F.lit(1), lead), F.upper(F.substring(token, lead + 1, F.lit(1))), F.substring(token, lead + 2, F.length(token)))
        inner = (i > 0) & (i < F.size(tokens) - 1)
        return (
            F.when(~token.rlike("[a-z]"), token)
            .when(bare.isin(*acronyms), F.replace(token, bare, F.upper(bare)))
            .when(inner & bare.isin(*small), token)
            .otherwise(capital)
        )

    return F.when((up == 0) | (low * 5 > low + up), text).otherwise(F.array_join(F.transform(tokens, cased), ""))


def _one_line(line: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(line, r"(?U)\s+", " "), F.lit("­"), F.lit("")))


def is_byline(line: Column) -> Column:
    """A short line with a byline's opening, or of two to five capitalised words without connectives."""
    text = _one_line(F.coalesce(line, F.lit("")))
    words = F.filter(F.split(F.regexp_replace(text, "[.,]", ""), " "), lambda w: w != "")
    name = text.rlike("[a-z]") & ~text.rlike(f"(?i){ascii_words(NOT_A_NAME)}") & F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike("^[A-Z]"))
    return (F.length(text) <= 70) & ~text.rlike("[?!:;]$") & (text.rlike(f"(?i){BYLINE_PREFIX}") | name)


def byline_name(line: Column) -> Column:
    """The name in a byline, without its opening and credentials; null if what is left can't be one."""
    bare = F.regexp_replace(_one_line(line), f"(?i){BYLINE_PREFIX}", "")
    name = F.trim(F.regexp_replace(F.get(F.split(bare, r"\s*[,.]\s+"), F.lit(0)), "[.,;:]+$", ""))
    return F.when(F.length(name).between(1, 60) & (F.size(F.split(name, " +")) <= 6) & ~name.rlike(f"(?i){ascii_words(NOT_A_NAME)}"), name)


def author_in(blocks: DataFrame, key: str, position: str, kind: str, text: str) -> DataFrame:
    """Per key the byline among its first four blocks (key, position, author): the first paragraph of that form, if no longer paragraph comes before it."""
    order = Window.partitionBy(key).orderBy(position)
    own = T.tidy_ends(F.coalesce(text, F.lit("")))
    said = (F.col(kind) == "paragraph") & (own != "")
    head = blocks.select(key, position, F.row_number().over(order).alias("_n"), said.alias("_said"), own.alias("_own")).filter("_n <= 4 AND _said")
    name = F.regexp_extract("_own", BYLINE, 1)
    event = head.select(key, position, F.when(F.length("_own") > 60, F.lit("")).otherwise(name).alias("author"), (F.length("_own") > 60).alias("_prose")).filter("_prose OR author <> ''")
    first = event.groupBy(key).agg(F.min_by(F.struct(position, "author"), position).alias("_first"))
    return first.select(key, f"_first.{position}", "_first.author").filter("author <> ''")


def openings(pages: DataFrame, key: str, page: str, strap: str, headline: str, confident: str) -> DataFrame:
    """The articles of an issue by its pages alone: one begins on each page after the first with a strap, or with a certain
    headline of 15 characters, and ends before the next. Front matter begins none."""
    order = Window.partitionBy(key).orderBy(page)
    title = F.when(F.length(headline) >= 15, F.col(headline))
    label = F.nullif(F.col(strap), F.lit(""))
    last = F.max(page).over(Window.partitionBy(key))
    rows = pages.select(key, F.col(page).alias("start_page"), label.alias("_strap"), title.alias("_title"), F.coalesce(confident, F.lit(False)).alias("_sure"), last.alias("_last"))
    rows = rows.filter((F.col("start_page") > 1) & (F.col("_strap").isNotNull() | (F.col("_title").isNotNull() & F.col("_sure"))) & ~F.col("_strap").eqNullSafe(FRONT_MATTER))
    order = Window.partitionBy(key).orderBy("start_page")
    end = F.coalesce(F.lead("start_page").over(order), F.col("_last") + 1) - 1
    return rows.select(key, "start_page", end.alias("end_page"), F.coalesce("_title", "_strap").alias("title"), F.coalesce("_strap", F.lit(DEFAULT_STRAP)).alias("section"))


def text_of_ranges(ranges: DataFrame, pages: DataFrame, key: str, page: str, text: str, entry: str, most: int | None = None) -> DataFrame:
    """Each entry (key, entry, start, end) with the texts of its pages in order, each after a line feed; of the first ``most`` pages if given.
    Ranges become (key, page) rows, so the join is on equality and an issue with many pages is spread. Pages that lack give nothing; null texts count as empty."""
    end = F.col("end") if most is None else F.least(F.col("end"), F.col("start") + most - 1)
    wanted = ranges.filter(F.col("start") <= F.col("end")).select(key, entry, F.explode(F.sequence(F.col("start"), end)).alias(page))
    found = wanted.join(pages.select(key, page, F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))).alias("_text")), [key, page])
    texts = found.groupBy(key, entry).agg(F.array_sort(F.collect_list(F.struct(page, "_text"))).alias("_texts"))
    joined = texts.select(key, entry, F.array_join(F.col("_texts._text"), "").alias("text"))
    return ranges.select(key, entry).join(joined, [key, entry], "left").fillna("", ["text"])


def elements_at(points: DataFrame, elements: DataFrame, key: str, position: str, text: str, offset: str) -> DataFrame:
    """Points with the element of their key that holds their offset, where elements follow each other with a separator of one
    character; null before the first. An as-of join without a join: points take the last mark before them in one sorted pass."""
    before = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.coalesce(F.sum(F.length(F.coalesce(text, F.lit(""))) + 1).over(before), F.lit(0)).cast("long")
    marks = elements.select(key, mark.alias("_at"), F.lit(0).alias("_point"), F.col(position).alias("_element"), F.lit(None).cast(points.schema[offset].dataType).alias(offset))
    asked = points.select(key, F.col(offset).cast("long").alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast(elements.schema[position].dataType).alias("_element"), offset)
    order = Window.partitionBy(key).orderBy("_at", "_point", "_element").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(asked).withColumn("element", F.last("_element", ignorenulls=True).over(order))
    return seen.filter("_point = 1").select(key, offset, "element")


def synopsis_callouts(blocks: DataFrame, key: str, position: str, kind: str, text: str) -> DataFrame:
    """Blocks (key, position, kind, title, text) where a synopsis label takes the paragraph after it into a callout. Of labels in a row every second one is taken."""
    order = Window.partitionBy(key).orderBy(position)
    own = T.tidy_ends(F.coalesce(text, F.lit("")))
    rows = blocks.select(key, position, F.col(kind).alias("kind"), F.col(text).alias("text"), own.alias("_own"), F.row_number().over(order).alias("_n"))
    rows = rows.withColumn("_label", F.coalesce((F.col("kind") == "paragraph") & F.col("_own").rlike(f"(?i){SYNOPSIS}"), F.lit(False)))
    place = F.col("_n") - F.coalesce(F.last(F.when(~F.col("_label"), F.col("_n")), ignorenulls=True).over(order), F.lit(0))
    body = F.lead(F.when((F.col("kind") == "paragraph") & (F.col("_own") != ""), F.col("_own"))).over(order)
    rows = rows.withColumn("_body", F.when(F.col("_label") & (place % 2 == 1), body))
    taken = F.coalesce(F.lag(F.col("_body").isNotNull()).over(order), F.lit(False))
    takes = F.col("_body").isNotNull()
    rows = rows.withColumn("_taken", taken).filter(~F.col("_taken"))
    return rows.select(key, position, F.when(takes, "callout").otherwise(F.col("kind")).alias("kind"), F.when(takes, F.col("_own")).alias("title"), F.when(takes, F.col("_body")).otherwise(F.col("text")).alias("text"))


def drop_caps_restored(blocks: DataFrame, key: str, position: str, kind: str, text: str) -> DataFrame:
    """Blocks (key, position, kind, text) where a first paragraph that opens in lower case and has no end gets its initial, and the rest,
    from the next paragraph if that is at most three blocks on and begins with a capital before a small letter."""
    order, whole = Window.partitionBy(key).orderBy(position), Window.partitionBy(key)
    own = T.tidy_ends(F.coalesce(text, F.lit("")))
    rows = blocks.select(key, position, F.col(kind).alias("kind"), F.col(text).alias("text"), own.alias("_own"), F.row_number().over(order).alias("_n"))
    rows = rows.withColumn("_p", F.when(F.col("kind") == "paragraph", F.count(F.when(F.col("kind") == "paragraph", 1)).over(order)))
    at = lambda p, c: F.max(F.when(F.col("_p") == p, F.col(c))).over(whole)
    rows = rows.withColumns({"_first": at(1, "_own"), "_donor": at(2, "_own"), "_gap": at(2, "_n") - at(1, "_n")})
    open_ended = F.col("_first").rlike(r"^\p{Ll}") & ~F.col("_first").rlike(r"""[.!?:;”"’')\]]$""")
    mends = F.coalesce(open_ended & (F.col("_gap") <= 3) & F.col("_donor").rlike(r"^\p{Lu}\p{Ll}"), F.lit(False))
    mended = F.concat(F.substring("_donor", 1, 1), F.col("_first"), F.lit(" "), T.tidy_ends(F.substring(F.col("_donor"), F.lit(2), F.length("_donor"))))
    rows = rows.withColumn("_mends", mends).filter(~(F.col("_mends") & F.col("_p").eqNullSafe(2)))
    return rows.select(key, position, "kind", F.when(F.col("_mends") & (F.col("_p") == 1), mended).otherwise(F.col("text")).alias("text"))


def natural_key(name: Column) -> Column:
    """A key that sorts runs of digits by their number; of longer runs the last twelve digits count."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "([0-9]+)", "000000000000$1"), "[0-9]*([0-9]{12})", "$1")


def resync_outcome(mode: Column, category: Column, status: Column, pairs: list[tuple[Column, Column]]) -> Column:
    """What a second load does with an article: null for one that isn't a PDF, else category_missing, not_touched, unchanged or updated. Nulls are equal."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & a.eqNullSafe(b)
    return F.when(~mode.eqNullSafe("PDF"), F.lit(None).cast("string")).when(category.isNull(), "category_missing").when(~status.eqNullSafe("DRAFT"), "not_touched").when(same, "unchanged").otherwise("updated")


def notice(kind: Column, title: Column, reason: Column, volume: Column, issue: Column, site: str) -> Column:
    """The heading and the message of a notice, as a struct; null for other kinds."""
    said = lambda heading, pattern, *parts: F.struct(F.lit(heading).alias("heading"), F.format_string(pattern, *parts).alias("message"))
    return (
        F.when(kind == "ARTICLE_PUBLISHED", said("New article published", f'"%s" has just been published on {site}.', title))
        .when(kind == "ARTICLE_APPROVED", said("Your article was approved", '"%s" has been approved and is now published.', title))
        .when(kind == "ARTICLE_REJECTED", said("Your article was not approved", '"%s" was rejected. Reason: %s', title, reason))
        .when(kind == "MAGAZINE_PUBLISHED", said("New magazine published", '"%s" (Volume %s, Issue %s) is now available.', title, volume, issue))
    )


def magazine_command(command: Column, status: Column, published_at: Column, now: Column) -> Column:
    """status, published_at and code after publish or archive: only a draft is published, what is archived stays so."""
    done = lambda s, at, code: F.struct(s.alias("status"), at.alias("published_at"), F.lit(code).cast("string").alias("code"))
    return (
        F.when((command == "publish") & (status == "DRAFT"), done(F.lit("PUBLISHED"), now, None))
        .when(command == "publish", done(status, published_at, "NOT_DRAFT"))
        .when((command == "archive") & status.isin("DRAFT", "PUBLISHED"), done(F.lit("ARCHIVED"), published_at, None))
        .when(command == "archive", done(status, published_at, "ALREADY_ARCHIVED"))
        .otherwise(done(status, published_at, "UNKNOWN_COMMAND"))
    )
