"""Content blocks: validation, reading time, and blocks from HTML.

A block is a row of key, position, block_type and content (JSON text), so a document of any length is spread over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import decode_entities, tidy, tidy_ends, word_count

#: Block types, styles of lists, the longest optional texts, and the fields whose words count.
BLOCK_TYPES = ["heading", "paragraph", "image", "quote", "callout", "table", "figure", "list", "formula", "reference"]
LIST_STYLES = ["ordered", "unordered", "roman", "letter"]
LONGEST = {
    ("image", "caption"): 500, ("image", "altText"): 300, ("quote", "attribution"): 200, ("callout", "title"): 200, ("table", "caption"): 300,
    ("figure", "caption"): 500, ("figure", "source"): 300, ("formula", "note"): 300,
}
WORD_FIELDS = ["text", "title", "caption", "attribution", "note", "expression"]
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
WORDS_A_MINUTE = 200


def _field(name: str) -> Column:
    return F.get_json_object("content", f"$.{name}")


def block_errors() -> Column:
    """The list of what is wrong with a block; empty if nothing is."""
    kind = F.col("block_type")

    no = F.lit(False)
    blank = lambda c: F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*$")
    items = F.from_json(_field("items"), "array<string>")
    cites = F.from_json(_field("items"), "array<struct<label:string,url:string>>")
    columns, rows = F.from_json(_field("columns"), "array<string>"), F.from_json(_field("rows"), "array<array<string>>")
    level = _field("level").try_cast("int")
    few = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    rules = [
        (kind.isNull() | ~kind.isin(BLOCK_TYPES), "type: unknown"),
        (kind.isin("heading", "paragraph", "quote", "callout") & blank(_field("text")), "text: required"),
        ((kind == "heading") & ~F.coalesce(level.between(1, 6), no), "level: out of range"),
        (kind.isin("image", "figure") & ~F.coalesce(_field("mediaId").rlike(_UUID), no), "mediaId: not a uuid"),
        ((kind == "formula") & blank(_field("expression")), "expression: required"),
        ((kind == "list") & ~F.coalesce(_field("style").isin(LIST_STYLES), no), "style: unknown"),
        (kind.isin("list", "reference") & few(F.from_json(_field("items"), "array<string>")), "items: required"),
        ((kind == "list") & F.coalesce(F.exists(items, blank), no), "items: blank"),
        ((kind == "reference") & F.coalesce(F.exists(cites, lambda x: blank(x.label)), no), "items.label: required"),
        ((kind == "reference") & F.coalesce(F.exists(cites, lambda x: x.url.isNotNull() & ~x.url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:\\S+$")), no), "items.url: not a URL"),
        ((kind == "table") & few(columns), "columns: required"),
        ((kind == "table") & F.coalesce(F.exists(columns, blank), no), "columns: blank"),
        ((kind == "table") & few(rows), "rows: required"),
        ((kind == "table") & F.coalesce(F.exists(rows, lambda r: F.size(r) != F.size(columns)), no), "rows: another width"),
        *(((kind == k) & F.coalesce(F.length(tidy_ends(_field(name))) > most, no), f"{name}: too long") for (k, name), most in LONGEST.items()),
    ]
    return F.array_compact(F.array(*(F.when(wrong, F.lit(message)) for wrong, message in rules)))


def block_words() -> Column:
    """Words of a block's texts, list items, labels of references, and cells, whatever its type."""
    out = F.lit(0).cast("long")
    for name in WORD_FIELDS:
        out = out + word_count(_field(name))
    items = F.transform(F.from_json(_field("items"), "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.label")).otherwise(x))
    rows = F.flatten(F.from_json(_field("rows"), "array<array<string>>"))
    for each in (items, F.from_json(_field("columns"), "array<string>"), rows):
        out = out + word_count(F.array_join(each, " "))
    return out


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / F.lit(WORDS_A_MINUTE))).cast("long")


def minutes_of_pages(pages: Column) -> Column:
    return F.greatest(F.lit(1), F.round(pages * 2)).cast("long")


def text_words() -> Column:
    """Words of a block that count as prose: its text, its expression, and the items of a list that are texts."""
    value = F.try_parse_json(F.col("content"))
    items = F.try_variant_get(value, "$.items", "array<variant>")
    texts = F.array_compact(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    field = lambda name: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))
    return word_count(F.concat_ws(" ", field("text"), field("expression"), F.array_join(texts, " ")))


def quality_warnings(docs: DataFrame, blocks: DataFrame, key: str, house: str, least_words: int = 60) -> DataFrame:
    """Per document (key, category, summary, author) its blocks, words of prose, and what makes it not worth publishing, in this order: no blocks, few words (if it has
    blocks), no category, no summary, no byline (the author is the publication), a paragraph with the text of the paragraph before it."""
    w = Window.partitionBy(key).orderBy("position")
    text = F.get_json_object("content", "$.text")
    paragraph = F.when(F.col("block_type") == "paragraph", F.struct(text.alias("text")))
    seen = blocks.withColumns({"_words": text_words(), "_own": paragraph}).withColumn("_again", F.col("_own").isNotNull() & F.coalesce(F.lag("_own").over(w) == F.col("_own"), F.lit(False)))
    sums = seen.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.sum("_words").alias("words"), F.max("_again").alias("_again"))
    out = docs.join(sums, key, "left").withColumns({"blocks": F.coalesce("blocks", F.lit(0)), "words": F.coalesce("words", F.lit(0)), "_again": F.coalesce("_again", F.lit(False))})
    lacks = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rules = [
        (F.col("blocks") == 0, "no blocks"), ((F.col("blocks") > 0) & (F.col("words") < least_words), "few words"), (lacks("category"), "no category"), (lacks("summary"), "no summary"),
        (F.col("author").eqNullSafe(house), "no byline"), (F.col("_again"), "repeated paragraph"),
    ]
    return out.select(key, "blocks", "words", F.array_compact(F.array(*(F.when(test, F.lit(said)) for test, said in rules))).alias("warnings"))


def html_to_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, block_type, content: headings, paragraphs and lists of the pages' bodies.

    The text is cut before each tag of a block, so tags that are never closed do no harm; scripts, styles and comments go.
    List items that follow each other are one list. Blocks without text are left out; null pages have none.
    """
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    parts = pages.select(key, F.posexplode(F.split(body, r"(?i)(?=<(?:/?(?:h[1-6]|p|li|ul|ol|div|blockquote|article|nav|footer|table)\b))")).alias("at", "part"))
    parts = parts.select(key, "at", F.lower(F.regexp_extract("part", r"^<(/?\w+)", 1)).alias("tag"), tidy(decode_entities(F.regexp_replace("part", r"(?s)<[^>]*>", " "))).alias("text"))
    parts = parts.filter("text <> ''")
    w = Window.partitionBy(key).orderBy("at")
    item = F.col("tag") == "li"
    start = ~item | ~F.coalesce(F.lag("tag").over(w) == "li", F.lit(False))
    runs = parts.withColumn("start", start.cast("int")).withColumn("run", F.sum("start").over(w))
    lists = runs.groupBy(key, "run").agg(F.min_by("tag", "at").alias("tag"), F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text).alias("texts"))
    heading = F.col("tag").rlike("^h[1-6]$")
    content = F.when(F.col("tag") == "li", F.to_json(F.struct(F.lit("unordered").alias("style"), F.col("texts").alias("items")))).when(
        heading, F.to_json(F.struct(F.substring("tag", 2, 1).try_cast("int").alias("level"), F.get("texts", F.lit(0)).alias("text")))
    ).otherwise(F.to_json(F.struct(F.get("texts", F.lit(0)).alias("text"))))
    kind = F.when(F.col("tag") == "li", "list").when(heading, "heading").when(F.col("tag") == "blockquote", "quote").otherwise("paragraph")
    return lists.select(key, F.row_number().over(Window.partitionBy(key).orderBy("run")).alias("position"), kind.alias("block_type"), content.alias("content"))
