"""Small readers over pages, blocks and positions of an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

MOST_CAPTION = 160


def needs_ocr(pages: DataFrame, key: str, text: str, least: int = 100) -> DataFrame:
    """Per key: pages, chars that aren't white space, needs_ocr: fewer than ``least`` of them a page. Null pages count, without characters."""
    chars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))
    out = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(chars).alias("chars"))
    return out.withColumn("needs_ocr", F.col("chars") / F.col("pages") < least)


def captions(blocks: DataFrame, key: str, position: str, kind: str, text: str) -> DataFrame:
    """Images (key, position) with the caption that the next block gives: a short paragraph that opens like a phrase of its own; else null."""
    order = Window.partitionBy(key).orderBy(position)
    cut = T.tidy_ends(F.col("_text"))
    fits = (F.col("_kind") == "paragraph") & F.length(cut).between(1, MOST_CAPTION) & cut.rlike('^[\\p{Lu}\\p{N}"“(]') & ~(cut.rlike("[.!?]$") & (T.word_count(cut) > 20))
    out = blocks.withColumn("_kind", F.lead(kind).over(order)).withColumn("_text", F.lead(text).over(order))
    return out.filter(F.col(kind) == "image").select(key, position, F.when(fits, cut).alias("caption"))


def containing(points: DataFrame, ranges: DataFrame, key: str, position: str) -> DataFrame:
    """Points with the first of their key's ranges (range_id, start, end) that holds them, by start, then id; both ends are included. range_id is null if none does.

    Of ranges in that order only those matter that end later than all before them: a point's range is the first of these that ends at or after it, if it
    begins in time. So points and ends are sorted once, and no point meets all ranges of its key. Repeated points stay; ranges that lack an end hold nothing.
    """
    before = Window.partitionBy("_key").orderBy("start", "range_id").rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.filter(F.col("start") <= F.col("end")).select(F.col(key).alias("_key"), "range_id", "start", "end")
    own = own.withColumn("_most", F.max("end").over(before)).filter(F.col("_most").isNull() | (F.col("end") > F.col("_most")))
    hits = own.select("_key", F.col("end").alias("_at"), F.lit(0).alias("_side"), F.struct("range_id", "start").alias("_range"))
    rows = points.select(F.col(key).alias("_key"), F.col(position).alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_row")).unionByName(hits, allowMissingColumns=True)
    ahead = Window.partitionBy("_key").orderBy(F.desc_nulls_last("_at"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_next", F.last("_range", True).over(ahead)).filter("_side = 1")
    return rows.select("_row.*", F.when(F.col("_next.start") <= F.col("_at"), F.col("_next.range_id")).alias("range_id"))


def distinctive(titles: DataFrame, key: str, text: str) -> DataFrame:
    """Words (key, word) that one title alone has."""
    words = titles.select(key, F.explode(F.array_distinct(F.filter(F.split(T.normal_key(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key)).filter("_n = 1").select(key, "word")


def first_seen(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Per key its distinct values, numbered from 1 in the order in which they first appear."""
    firsts = df.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_first"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_first", value)).cast("long")).drop("_first")


def issue_key(path: Column) -> Column:
    """The folder and the file's name without its extension, as lower-case words joined by hyphens."""
    name = F.concat_ws("--", F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit("")), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def page_file(number: Column) -> Column:
    return F.concat(F.lit("page-"), F.when(F.length(number.cast("string")) >= 3, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0")))


def signature(message: Column, secret: str) -> Column:
    """HMAC-SHA256 in lower-case hex, by two digests in the JVM. The secret has at most 64 bytes."""
    key = secret.encode().ljust(64, b"\0")
    if len(key) > 64:
        raise ValueError("the secret is longer than a block")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)


def signed(identifier: Column, secret: str) -> Column:
    return F.concat(identifier, F.lit("."), signature(identifier, secret))


def signer(token: Column, secret: str) -> Column:
    """Whose token it is: null unless it is an id, a dot, and the id's signature in 64 hex digits."""
    at = F.instr(token, ".")
    who, given = F.substring(token, F.lit(1), at - 1), F.substring(token, at + 1, F.length(token))
    return F.when((at > 1) & given.rlike("^[0-9a-f]{64}\\z") & (given == signature(who, secret)), who)
