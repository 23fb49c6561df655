"""Reading an issue's contents page, its page numbers and its cover, and the manifest that they make.

pages: issue, page (from 1 without gaps), text. What is printed in one magazine only, its name, is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources.scratch import written

#: Section labels as contents pages print them, and what they are called.
SECTIONS = {
    "editorial": "Editorial", "cover article": "Cover Story", "cover story": "Cover Story", "feature articles": "Feature Article", "feature article": "Feature Article",
    "feature story": "Feature Article", "tutorial": "Tutorial", "consumers desk": "Consumer Desk", "consumer desk": "Consumer Desk", "consumers' desk": "Consumer Desk",
    "news and events": "News and Events", "news & events": "News and Events",
}
DEFAULT_SECTION, ABOUT = "Feature Article", "About"
MARKER = "(?i)table of contents?"
#: A title's most characters, a label's, the pages that are looked through for contents, lines with numbers that make a page contents.
TITLE_CHARS, LABEL_CHARS, CONTENTS_WITHIN, LEAST_ANCHORS = 160, 40, 4, 3
COVER_PAGES, LEAST_FOLIOS, LEAST_AGREEMENT, MOST_PAGES = 3, 5, 0.7, 25
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*"
PERIOD = rf"(?i)({_MONTH}\.?\s*(?:[-–—/]\s*(?:{_MONTH}\.?)?)?)\s*,?\s*(20[0-9]{{2}})"
COVER = r"(?i)Volume\s+([IVX]+|[0-9]+)\s*[,\s]\s*Issue\s+([0-9]+)"
FILE_NAME = r"(?i)^V([0-9]+)(?:[_\s]*I([0-9]+))?"
FOLDER = r"(?i)volume\s*([0-9]+|[IVX]+)"


def section_label(line: Column, about: str) -> Column:
    """The section that a line, without white space at its ends, names, null if it is none: case, spaces, final stops and the apostrophe's form don't matter; long
    lines are titles. Only lines that begin like a name are looked at closely."""
    key = F.replace(F.lower(F.regexp_replace(T.tidy(line), "[.:]+$", "")), F.lit("’"), F.lit("'"))
    sections = {about: ABOUT, **SECTIONS}
    names = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
    n = 3 if all(x[:3].isascii() and x[:3].isalpha() and len(x) >= 3 for x in sections) else 0
    begins = F.lower(F.substring(line, 1, n)).isin(*sorted({x[:n] for x in sections}))
    return F.when(begins, F.when(F.length(key) <= LABEL_CHARS, F.try_element_at(names, key)))


def numbered_line(line: Column, pages: Column) -> Column:
    """text and folio of a line, without white space at its ends, that ends in a page number of the issue; null for others."""
    found = r"(?U)^(.*?)\s+([0-9]{1,3})$"
    folio = F.regexp_extract(line, found, 2).try_cast("long")
    digit = F.substring(line, -1, 1).between("0", "9")  # ends most lines' work
    return F.when(digit, F.when(folio.between(1, pages), F.struct(F.regexp_extract(line, found, 1).alias("text"), folio.alias("folio"))))


def _trimmed_lines(text: Column) -> Column:
    return F.transform(T.lines_of(text), T.tidy_ends)


def page_facts(pages: DataFrame) -> DataFrame:
    """issue, page, text (of opening pages only), offset: how far the page number that stands among the first and last two lines is ahead of the page, if one does.
    All that contents, covers and manifests need of pages: whole texts are read once, and only opening pages are kept."""
    folio = F.get(F.filter(T.outer_lines(F.col("text")), T.is_folio), F.lit(0))
    head = F.when(F.col("page") <= CONTENTS_WITHIN + 1, F.coalesce("text", F.lit("")))
    return pages.select("issue", "page", head.alias("text"), (T.tidy_ends(folio).cast("long") - F.col("page")).alias("offset"))


def contents_pages(pages: DataFrame) -> DataFrame:
    """issue, pages (how many), contents_page, had_marker: the first of the opening pages with the heading, else the first with three numbered lines, else null."""
    sizes = pages.groupBy("issue").agg(F.count(F.lit(1)).alias("pages"))
    head = pages.filter(F.col("page") <= CONTENTS_WITHIN).select("issue", "page", "text").join(sizes, "issue")
    anchors = F.size(F.filter(_trimmed_lines(F.col("text")), lambda x: numbered_line(x, F.col("pages")).isNotNull()))
    marked = F.min(F.when(F.coalesce("text", F.lit("")).rlike(MARKER), F.col("page"))).alias("_marked")
    found = head.groupBy("issue").agg(marked, F.min(F.when(anchors >= LEAST_ANCHORS, F.col("page"))).alias("_listed"))
    return sizes.join(found, "issue", "left").select("issue", "pages", F.coalesce("_marked", "_listed").alias("contents_page"), F.col("_marked").isNotNull().alias("had_marker"))


def contents_entries(pages: DataFrame, about: str) -> DataFrame:
    """issue, entry (from 1), section, title, folio: the entries of contents pages, which may run on to the next page.

    A line that ends in a page number closes an entry; its title takes in the two lines before it at most, back to the entry or label before.
    A line that is a section's label opens that section; an entry that is one is of it. Blank lines and lines with a star are passed over.
    """
    where = contents_pages(pages).filter("contents_page IS NOT NULL")
    head = pages.filter(F.col("page") <= CONTENTS_WITHIN + 1)
    region = head.join(where.withColumnRenamed("pages", "_pages"), "issue").filter(F.col("page") - F.col("contents_page") <= 1).filter(F.col("page") >= F.col("contents_page"))
    whole = region.groupBy("issue", "_pages", "had_marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p.text), "\n").alias("_text"))
    body = F.when(F.col("had_marker"), F.array_join(F.slice(F.split("_text", MARKER), 2, 1 << 30), "\n")).otherwise(F.col("_text"))
    # not posexplode: for it Spark tests the array in a filter of its own, which reads the text again for each mention
    lines = whole.select("issue", "_pages", F.posexplode_outer(_trimmed_lines(body)).alias("_n", "_line")).filter((F.col("_line") != "") & ~F.startswith(F.col("_line"), F.lit("*")))
    label = section_label(F.col("_line"), about)
    lines = lines.withColumn("_label", label).withColumn("_end", F.when(F.col("_label").isNull(), numbered_line(F.col("_line"), F.col("_pages"))))
    order = Window.partitionBy("issue").orderBy("_n")
    plain = F.when(F.col("_label").isNull() & F.col("_end").isNull(), F.col("_line"))
    lines = lines.withColumn("_plain", plain).withColumns({
        "_one": F.lag("_plain", 1).over(order), "_two": F.lag("_plain", 2).over(order), "_section": F.last("_label", True).over(order),
    }).filter("_end IS NOT NULL")
    title = F.substring(T.tidy(F.concat_ws(" ", F.when(F.col("_one").isNotNull(), F.col("_two")), "_one", "_end.text")), 1, TITLE_CHARS)
    own = section_label(F.col("_end.text"), about)
    out = lines.select("issue", "_n", F.coalesce(own, "_section", F.lit(DEFAULT_SECTION)).alias("section"), title.alias("title"), F.col("_end.folio").alias("folio")).filter(F.length("title") >= 3)
    return out.select("issue", F.row_number().over(order).cast("long").alias("entry"), "section", "title", "folio")


def folio_offsets(facts: DataFrame) -> DataFrame:
    """issue, offset, times, observed: how far printed page numbers are ahead of pages by most of the pages that print one (``page_facts``);
    of equal votes the one that is cast first. Issues without any have none."""
    counts = facts.filter("offset IS NOT NULL").groupBy("issue", "offset").agg(F.count(F.lit(1)).alias("times"), F.min("page").alias("_first"))
    best = counts.groupBy("issue").agg(F.max_by(F.struct("offset", "times"), F.struct("times", -F.col("_first"))).alias("_best"), F.sum("times").alias("observed"))
    return best.select("issue", "_best.offset", "_best.times", "observed")


def cover_facts(pages: DataFrame, files: DataFrame, own: str) -> DataFrame:
    """issue, volume, number, period, cover_title, notes. files: issue, file_name, folder; ``own``: a pattern of the magazine's name.

    The cover's volume and number give way to the file name's, and the volume then to the folder's; notes say so. The cover title is up to three
    lines of the first page before the contents that are neither name, volume, period nor number.
    """
    head = pages.filter(F.col("page") <= COVER_PAGES).groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("_head"))
    rows = files.join(head, "issue", "left").withColumn("_text", F.coalesce(F.array_join(F.transform("_head", lambda p: p.text), "\n"), F.lit("")))
    number = lambda c, pattern, k: T.small_number(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, k), F.lit(""))).cast("long")
    facts = {"_cv": number("_text", COVER, 1), "_ci": number("_text", COVER, 2), "_nv": number("file_name", FILE_NAME, 1), "_ni": number("file_name", FILE_NAME, 2), "_fv": number("folder", FOLDER, 1)}
    rows = rows.withColumns(facts)
    said = lambda what, a, source, b: F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(F.lit(f"cover has {what} "), a.cast("string"), F.lit(f", {source} has "), b.cast("string")))
    cv, ci, nv, ni, fv = (F.col(c) for c in facts)
    after_name = F.when(cv.isNotNull(), F.coalesce(nv, cv))  # the folder is compared with what the file name left
    notes = F.array_compact(F.array(said("volume", cv, "file name", nv), said("volume", after_name, "folder", fv), said("issue", ci, "file name", ni)))
    volume = F.when(cv.isNotNull(), F.coalesce(fv, nv, cv)).otherwise(F.coalesce(nv, fv))
    period = F.concat(F.regexp_replace(F.regexp_extract("_text", PERIOD, 1), r"\s+", ""), F.lit(" "), F.regexp_extract("_text", PERIOD, 2))
    lines = _trimmed_lines(F.get("_head", F.lit(0)).text)
    first = F.array_position(F.transform(lines, lambda x: x.rlike("(?i)table of contents")), True)
    lines = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    title = F.filter(lines, lambda x: (F.length(x) > 3) & ~x.rlike(f"(?i){own}") & ~x.rlike("(?i)volume|issue") & ~x.rlike(PERIOD) & ~x.rlike("^[0-9]+$"))
    first_page = F.get("_head", F.lit(0)).page == 1
    return rows.select(
        "issue", volume.alias("volume"), F.coalesce(ni, ci).alias("number"), F.when(F.col("_text").rlike(PERIOD), F.trim(period)).alias("period"),
        F.when(first_page, F.nullif(T.tidy(F.array_join(F.slice(title, 1, 3), " ")), F.lit(""))).alias("cover_title"), notes.alias("notes"),
    )


def article_ranges(pages: DataFrame, about: str) -> DataFrame:
    """issue, index (from 0), section, title, start_page, end_page, capped_from, skip: entries whose page is in the issue, in the order of pages, each up to the next one's.
    The last one's rest is cut to ``MOST_PAGES`` pages, and capped_from says where it would have ended. What only tells about the magazine is to be skipped."""
    facts = written(page_facts(pages), "page-facts")
    return _ranges(facts, contents_entries(facts, about), about)


def _ranges(facts: DataFrame, entries: DataFrame, about: str) -> DataFrame:
    sizes = facts.groupBy("issue").agg(F.count(F.lit(1)).alias("_pages"))
    rows = entries.join(sizes, "issue").join(folio_offsets(facts).select("issue", "offset"), "issue", "left")
    rows = rows.withColumn("start_page", F.col("folio") - F.coalesce("offset", F.lit(0))).filter(F.col("start_page").between(1, F.col("_pages")))
    order = Window.partitionBy("issue").orderBy("start_page", "entry")
    following = F.lead("start_page").over(order)
    rows = rows.withColumn("_next", following).withColumn("_end", F.when(F.col("_next").isNull(), F.col("_pages")).otherwise(F.greatest("start_page", F.col("_next") - 1)))
    capped = F.col("_next").isNull() & (F.col("_end") - F.col("start_page") + 1 > MOST_PAGES)
    skip = F.lower("section").isin(about, "about") | F.lower("title").isin(about, "about")
    return rows.select(
        "issue", (F.row_number().over(order) - 1).cast("long").alias("index"), "section", "title", "start_page",
        F.when(capped, F.col("start_page") + MOST_PAGES - 1).otherwise(F.col("_end")).alias("end_page"), F.when(capped, F.col("_end")).alias("capped_from"), skip.alias("skip"),
    )


def manifests(pages: DataFrame, files: DataFrame, about: str, own: str) -> DataFrame:
    """One row for each issue of files: volume, number, period, cover_title, pages, offset, agreement, articles (how many), warnings, confidence (ok or review).

    Warnings, in this order: the cover's notes; what the cover lacks; contents without heading, without entries, or none; page numbers that are few or
    disagree; entries outside the pages; articles longer than ``MOST_PAGES``, the last one (cut there) and others that aren't skipped.
    """
    facts = written(page_facts(pages), "page-facts")
    entries = written(contents_entries(facts, about), "contents-entries")
    articles = _ranges(facts, entries, about)
    long = F.when(F.col("capped_from").isNotNull(), F.concat(F.lit("capped: "), "title")).when(~F.col("skip") & (F.col("end_page") - F.col("start_page") + 1 > MOST_PAGES), F.concat(F.lit("long: "), "title"))
    per = articles.withColumn("_long", long).groupBy("issue").agg(F.count(F.lit(1)).alias("articles"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_long").isNotNull(), F.struct("index", "_long")))), lambda x: x["_long"]).alias("_longs"))
    listed = entries.groupBy("issue").agg(F.count(F.lit(1)).alias("_entries"))
    rows = cover_facts(facts, files, own).join(contents_pages(facts), "issue", "left").join(folio_offsets(facts), "issue", "left").join(per, "issue", "left").join(listed, "issue", "left")
    rows = rows.fillna(0, ["articles", "_entries", "observed", "offset", "pages"]).withColumn("had_marker", F.coalesce("had_marker", F.lit(False)))
    share = F.col("times") / F.col("observed")
    warnings = F.array_compact(F.concat("notes", F.array(
        F.when(F.col("volume").isNull(), "no volume"), F.when(F.col("number").isNull(), "no issue number"), F.when(F.col("period").isNull(), "no period"),
        F.when(F.col("contents_page").isNull(), "no contents").when(~F.col("had_marker"), F.concat(F.lit("contents without heading on page "), F.col("contents_page").cast("string"))),
        F.when(F.col("_entries") == 0, "no entries"),
        F.when(F.col("observed") < LEAST_FOLIOS, F.concat(F.lit("page numbers on "), F.col("observed").cast("string"), F.lit(" pages"))).when(share < LEAST_AGREEMENT, F.concat(F.lit("page numbers agree on "), F.floor(share * 100 + 0.5).cast("string"), F.lit(" %"))),
        F.when((F.col("articles") > 0) & (F.col("articles") < F.col("_entries")), F.concat(F.lit("outside the pages: "), (F.col("_entries") - F.col("articles")).cast("string"))),
    ), F.coalesce("_longs", F.array().cast("array<string>"))))
    rows = rows.withColumn("warnings", warnings)
    agreement = F.when(F.col("observed") > 0, F.round(share, 2)).otherwise(0.0)
    return rows.select("issue", "volume", "number", "period", "cover_title", "pages", "offset", agreement.alias("agreement"), "articles", "warnings", F.when(F.size("warnings") == 0, "ok").otherwise("review").alias("confidence"))
