"""Headline, author and section of an article from its opening page, and the planned record of an article."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import issues as I  # noqa: E741

_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
#: Running heads and imprints, which are no content; a magazine's own name and motto are the caller's.
MASTHEAD = (
    r"^volume\s+[ivx0-9]+", r"^issue\s*[-–]?\s*[ivx0-9]*$", rf"^{_MONTH}\.?\s*[-–—/]?\s*(?:{_MONTH}\.?)?\s*,?\s*(20[0-9]{{2}})?\.?$", r"^20[0-9]{2}$", r"^[0-9]{1,3}$", r"^www\.",
    r"^(editorial|advisory)\s+board$",
)
#: Straps over headlines and the sections they name; the one of the magazine itself has its name.
STRAPS = {
    "^editorial$": "Editorial", r"^cover\s+(story|article)$": "Cover Story", r"^feature\s+(article|story)s?$": "Feature Article", "^tutorials?$": "Tutorial",
    r"^consumers?'?s?\s+desk$": "Consumer Desk", r"^news\s*(and|&)\s*events$": "News and Events",
}
#: How credentials begin, and what opens a body that was read as part of the last headline line.
AFFILIATION = r"^(former|formerly|ex[\s.-]|retd|advisor|chairman|director|managing|secretary|professor|editor|energy\s*&|member\b)"
BODY_OPENER = r"\s+(abstract|introduction|synopsis|summary|background)\b.*$"
STRAP_CHARS, STRAP_LINES, HEADLINE_LINES, BODY_CHARS, LEAST_HEADLINE, MOST_HEADLINE = 30, 6, 4, 80, 12, 160


def _tidy(line: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(line, r"(?U)\s+", " "), F.lit("­"), F.lit("")))


def strap(line: Column, about: str) -> Column:
    """The section that a strap names; null for other lines."""
    key = F.regexp_replace(_tidy(line), "[.:]+$", "")
    found = F.when(key.rlike(f"(?i){about}"), I.FRONT_MATTER)
    for pattern, name in STRAPS.items():
        found = found.when(key.rlike(f"(?i){pattern}"), name)
    return F.when(F.length(key) <= STRAP_CHARS, found)


def _read(lines: Column, about: str) -> Column:
    """headline_lines, author and used (lines read) of a page's lines after its strap: one step a line, until it is settled."""
    nothing = F.struct(F.array().cast("array<string>").alias("heads"), F.lit(None).cast("string").alias("author"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        state = lambda heads, author, used, done: F.struct(heads.alias("heads"), author.alias("author"), used.alias("used"), done.alias("done"))
        yes, no = F.lit(True), F.lit(False)
        return (
            F.when(s.done | (F.size(s.heads) >= HEADLINE_LINES), s)
            .when(strap(line, about).isNotNull(), state(s.heads, s.author, s.used + 1, no))
            .when(F.length(line) > BODY_CHARS, state(s.heads, s.author, s.used, yes))
            .when(I.is_byline(line), state(s.heads, F.when(F.size(s.heads) > 0, I.byline_name(line)), s.used, yes))
            .otherwise(state(F.concat(s.heads, F.array(line)), s.author, s.used + 1, line.rlike("[.?!]$")))
        )

    return F.aggregate(lines, nothing, step)


def front_pages(pages: DataFrame, keys: Sequence[str], text: str, about: str, own: Iterable[str] = ()) -> DataFrame:
    """keys, headline, author, section, confident, note ('no text', 'no headline', 'unverified' or null).

    Lines are read in order without running heads (``MASTHEAD`` and the patterns ``own``): a strap among the first six, then up to four headline lines, until
    one ends a sentence, is a name, or is as long as body copy. The author is the name there or, after a credential, in the next line. A
    headline of 12 to 160 characters is certain if a strap or an author stands beside it. An editorial has no headline. Null texts give a note only.

    At scale: one pass, each page by itself; the lines are folded by a built-in aggregate.
    """
    heads = "|".join(f"(?:{p})" for p in (*MASTHEAD, *own))
    content = F.filter(F.transform(T.lines_of(F.col(text)), _tidy), lambda x: (x != "") & ~x.rlike(f"(?i){heads}"))
    rows = pages.select(*keys, F.col(text).isNull().alias("_none"), content.alias("_lines"))
    straps = F.transform(F.slice("_lines", 1, STRAP_LINES), lambda x: strap(x, about))
    rows = rows.withColumn("_straps", straps).withColumn("_at", F.coalesce(F.array_position(F.transform("_straps", lambda x: x.isNotNull()), True), F.lit(0)).cast("int"))
    rows = rows.withColumn("section", F.when(F.col("_at") > 0, F.get("_straps", F.col("_at") - 1)))
    rows = rows.withColumn("_rest", F.slice("_lines", F.col("_at") + 1, F.greatest(F.size("_lines"), F.lit(1)))).withColumn("_read", _read(F.col("_rest"), about))
    one, two = (F.get("_rest", F.col("_read.used") + k) for k in (0, 1))
    known = lambda c, test: F.coalesce(test(c), F.lit(False)) & c.isNotNull()
    later = F.when(known(one, I.is_byline), I.byline_name(one)).when(known(one, lambda c: c.rlike(f"(?i){I.ascii_words(AFFILIATION)}")) & known(two, I.is_byline), I.byline_name(two))
    editorial = F.coalesce(F.col("section") == "Editorial", F.lit(False))
    any_line = (F.size("_read.heads") > 0) & ~editorial
    author = F.when(any_line, F.coalesce("_read.author", later))
    headline = F.when(any_line, F.trim(F.regexp_replace(_tidy(F.array_join("_read.heads", " ")), f"(?i){I.ascii_words(BODY_OPENER)}", "")))
    rows = rows.withColumn("author", author).withColumn("headline", F.nullif(headline, F.lit("")))
    sure = F.coalesce(F.length("headline").between(LEAST_HEADLINE, MOST_HEADLINE) & (F.col("section").isNotNull() | F.col("author").isNotNull()), F.lit(False))
    note = F.when(F.col("_none"), "no text").when(editorial, F.lit(None)).when(F.col("headline").isNull(), "no headline").when(~sure, "unverified")
    return rows.select(*keys, "headline", "author", "section", sure.alias("confident"), note.alias("note"))


def author_or_house(author: Column, house: str) -> Column:
    """The author without signs at the ends, if three characters are left; else the publication."""
    name = T.clean_title(author)
    return F.when(F.length(name) >= 3, name).otherwise(house)


def planned(articles: DataFrame, fronts: DataFrame, house: str, acronyms: Iterable[str], periods: DataFrame) -> DataFrame:
    """Per article of a manifest (issue, index, section, title, start_page, end_page, capped_from): title, title_source, needs_review, author, author_source, section, start_page, end_page, pages.

    fronts: issue, page and what ``front_pages`` gives; periods: issue, period. The strap goes before the contents' section. An editorial is titled by its issue's
    period. A range that was cut is whole again. Articles whose page isn't among fronts have the contents' facts only.
    """
    front = fronts.select("issue", F.col("page").alias("start_page"), "headline", "author", F.col("section").alias("_strap"), "confident")
    rows = articles.join(front, ["issue", "start_page"], "left").join(periods, "issue", "left")
    section = F.coalesce("_strap", "section", F.lit(I.DEFAULT_STRAP))
    end = F.coalesce("capped_from", "end_page")
    rows = T.with_picked_title(rows, F.col("headline"), F.col("title"), F.col("confident"), I.garbled, lambda t: I.title_case(t, acronyms), I.SMALL_WORDS)
    editorial = F.struct(F.concat_ws(" — ", F.lit("Editorial"), "period").alias("title"), F.lit("issue").alias("source"), F.lit(False).alias("needs_review"))
    rows = rows.withColumn("_section", section).withColumn("_title", F.when(section == "Editorial", editorial).otherwise(F.col("_picked")))
    return rows.select(
        "issue", "index", "_title.title", F.col("_title.source").alias("title_source"), "_title.needs_review", author_or_house(F.col("author"), house).alias("author"),
        F.when(F.col("author").isNotNull(), "byline").otherwise("house").alias("author_source"), F.col("_section").alias("section"), "start_page", end.alias("end_page"), (end - F.col("start_page") + 1).alias("pages"),
    )
