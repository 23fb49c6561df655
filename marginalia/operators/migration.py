"""Documents compared whatever the order of their keys, and a checked migration: rows updated and deleted by a join, given up as a whole if counts differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED = "url"


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def canonical(document: Column, dropped: str = RESOLVED) -> Column:
    """A JSON text with sorted keys at every depth and without one key at its top, which the server resolves; what isn't an object is kept whole. Null and what doesn't parse are an empty object."""
    value = F.try_parse_json(document)
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    # a variant keeps the keys of its objects sorted, so only the top, which loses a key, is written anew
    keys = F.array_sort(F.filter(F.map_keys(fields), lambda k: k != dropped))
    written = F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(":"), F.coalesce(F.to_json(F.try_element_at(fields, k)), F.lit("null"))))
    return F.when(fields.isNotNull(), F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}"))).otherwise(F.coalesce(F.to_json(value), F.lit("{}")))


def same_blocks(served: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """key, same: whether the blocks (key, position, kind, content) of both sides are the same in number, kind and content. Keys of one side only differ.

    At scale: texts are replaced by digests before they meet, so the join moves two digests a block.
    """
    digest = F.sha2(F.concat_ws("\n", "kind", canonical(F.col("content"))), 256)
    a, b = (df.select(key, "position", digest.alias(name)) for df, name in ((served, "_served"), (payload, "_payload")))
    return a.join(b, [key, "position"], "full").groupBy(key).agg(F.bool_and(F.coalesce(F.col("_served") == F.col("_payload"), F.lit(False))).alias("same"))


def editorials_moved(magazines: DataFrame, placements: DataFrame, articles: DataFrame, versions: DataFrame, blocks: DataFrame, label: str = "editorial") -> tuple[DataFrame, DataFrame]:
    """Magazines with editorial_title, editorial_author, editorial_summary and editorial_body taken over from the article that is placed under the label, and articles without those.

    magazines: magazine and those fields; placements: magazine, article, section; articles: article, pending, published; versions: article, version, title, author_name, summary; blocks: article, version,
    position, kind, content. The open version goes before the published one; a body is a JSON array of blocks in order, empty without any. If magazines updated aren't as many as
    placements under the label, both tables are an error when they are written, so nothing is.
    """
    mine = placements.filter(F.lower("section") == label).select("magazine", "article")
    current = articles.select("article", F.coalesce("pending", "published").alias("version"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", "content"))), lambda b: F.concat(F.lit('{"blockType":'), _quoted(b.kind), F.lit(',"content":'), b.content, F.lit("}")))
    bodies = blocks.join(mine.select("article").distinct(), "article", "left_semi").groupBy("article", "version").agg(F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")).alias("_body"))
    found = mine.join(current, "article").join(versions, ["article", "version"]).join(bodies, ["article", "version"], "left")
    new = F.struct("article", F.col("title").alias("editorial_title"), F.col("author_name").alias("editorial_author"), F.col("summary").alias("editorial_summary"), F.coalesce("_body", F.lit("[]")).alias("editorial_body"))
    content = found.groupBy("magazine").agg(F.min(new).alias("_new"))
    fields = ["editorial_title", "editorial_author", "editorial_summary", "editorial_body"]
    updated = magazines.join(content, "magazine", "left")
    # one row, with the message if the counts differ
    counts = mine.agg(F.count(F.lit(1)).alias("_asked")).join(magazines.join(content, "magazine", "left_semi").agg(F.count(F.lit(1)).alias("_done")))
    wrong = F.concat(F.lit("editorials don't match: "), F.col("_asked").cast("string"), F.lit(" placements, "), F.col("_done").cast("string"), F.lit(" magazines"))
    checked = F.broadcast(counts.select(F.when(F.col("_asked") != F.col("_done"), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)).alias("_fine")))
    magazines_out = updated.withColumns({f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}).join(checked).filter("_fine").select(*magazines.columns)
    articles_out = articles.join(mine.select("article").distinct(), "article", "left_anti").join(checked).filter("_fine").select(*articles.columns)
    return magazines_out, articles_out
