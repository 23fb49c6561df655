"""Cleaning, classifying and joining the text of pages and blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

EDGE_LINES = 3
LEAST_CHARS = 4
TITLE_POINTS, BODY_MOST, BODY_CHARS = 12, 3, 4000
LEAST_SCORE, LEAST_LEAD = 12, 2


def furniture(pages: DataFrame, issue: str, page: str, text: str, least: int = 3, share: float = 0.25) -> DataFrame:
    """issue, line, pages: lines among the first or last three non-blank ones of at least a quarter of an issue's pages, three at least.
    Page numbers and lines of fewer than four characters are none."""
    lines = F.filter(T.lines_of(F.col(text)), lambda x: T.tidy(x) != "")
    edges = F.concat(F.slice(lines, 1, EDGE_LINES), F.when(F.size(lines) > EDGE_LINES, F.slice(F.reverse(lines), 1, EDGE_LINES)).otherwise(F.array().cast("array<string>")))
    each = pages.select(issue, page, F.explode(F.array_distinct(F.transform(edges, T.furniture_key))).alias("line")).filter((F.length("line") >= LEAST_CHARS) & ~T.is_folio(F.col("line")))
    counts = each.distinct().groupBy(issue, "line").agg(F.count(F.lit(1)).alias("pages"))
    sizes = pages.groupBy(issue).agg(F.countDistinct(page).alias("_all"))
    return counts.join(sizes, issue).filter(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("_all") * F.lit(share)))).select(issue, "line", F.col("pages").cast("long").alias("pages"))


def strip_furniture(pages: DataFrame, found: DataFrame, issue: str, page: str, text: str) -> DataFrame:
    """issue, page, text without page numbers and furniture among the first and last three raw lines; three and more line feeds become two, and the ends are trimmed.
    A page's edge lines are joined to the furniture by issue and line, so no list of an issue's furniture is gathered."""
    rows = pages.select(issue, page, T.lines_of(F.col(text)).alias("_lines"))
    edges = F.concat(F.slice("_lines", 1, EDGE_LINES), F.slice(F.reverse("_lines"), 1, EDGE_LINES))
    each = rows.select(issue, page, F.explode(F.array_distinct(F.transform(edges, T.furniture_key))).alias("line"))
    known = each.join(found.select(issue, "line"), [issue, "line"]).groupBy(F.col(issue).alias("_issue"), F.col(page).alias("_page")).agg(F.collect_set("line").alias("_known"))
    rows = rows.join(known, (F.col(issue) == F.col("_issue")) & F.col(page).eqNullSafe(F.col("_page")), "left")
    at_edge = lambda i: (i < EDGE_LINES) | (i >= F.size("_lines") - EDGE_LINES)
    gone = lambda x: T.is_folio(x) | F.coalesce(F.array_contains("_known", T.furniture_key(x)), F.lit(False))
    kept = F.filter("_lines", lambda x, i: ~(at_edge(i) & gone(x)))
    return rows.select(issue, page, T.tidy_ends(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")).alias(text))


def clean_pages(pages: DataFrame, issue: str, page: str, text: str) -> DataFrame:
    stripped = strip_furniture(pages, furniture(pages, issue, page, text), issue, page, text)
    return stripped.withColumn(text, T.dehyphenate(F.col(text)))


def most_frequent(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, times, agreement: the value seen most often, of equals the one seen first, and its share of the key's rows."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max_by(F.struct(value, "times"), F.struct("times", -F.col("first"))).alias("best"), F.sum("times").alias("all"))
    return best.select(key, f"best.{value}", "best.times", F.round(F.col("best.times") / F.col("all"), 4).alias("agreement"))


def ranges_from_starts(df: DataFrame, key: str, start: str, last: str) -> DataFrame:
    """The rows with end_page: the page before the next start, at least their own start; the last one's is the number of pages."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return df.withColumn("end_page", F.greatest(F.col(start), F.coalesce(following - 1, F.col(last))))


def classify(docs: DataFrame, title: Column, body: Column, keywords: dict[str, Sequence[str]], fallback: str) -> DataFrame:
    """The documents with category, score and confident. Title hits weigh 12, body hits count up to 3 a keyword in the first
    4,000 characters (that is the rule, not a limit on texts read); strings match inside words too. Ties go to the first category."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, BODY_CHARS))
    top = F.lower(F.coalesce(title, F.lit("")))
    points = []
    for k, (name, words) in enumerate(keywords.items()):
        each = [T.occurrences(top, w) * TITLE_POINTS + F.least(T.occurrences(head, w), F.lit(BODY_MOST)) for w in words]
        points.append(F.struct(reduce(Column.__add__, each).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("category")))
    order = F.reverse(F.array_sort(F.array(*points)))
    best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    out = docs.withColumn("_best", best).withColumn("_second", F.coalesce(second["score"], F.lit(0)) if len(points) > 1 else F.lit(0))
    score = F.col("_best.score")
    return out.withColumns({
        "category": F.when(score > 0, F.col("_best.category")).otherwise(fallback),
        "score": score.cast("long"),
        "confident": (score >= LEAST_SCORE) & (score >= F.col("_second") + LEAST_LEAD),
    }).drop("_best", "_second")


def unique_slugs(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows with a slug of their own: in the order of the key, each takes its plain one or, while that is taken, -2, -3 and so on; empty names are "item".

    A numbered slug can equal the plain one of another row only within a family, the names that differ by numbers at their ends. Families
    without a plain slug that ends in a number are numbered by a window. Those with one are few; their rows pass in order through one
    task each as a stream, which keeps the family's taken slugs.
    """
    root = F.coalesce(F.nullif(T.slug(F.col(name)), F.lit("")), F.lit("item"))
    family = F.regexp_replace("_root", "(-[0-9]+)+$", "")
    rows = df.select(F.col(key).alias("_key"), root.alias("_root")).withColumn("_family", family)
    numbered = rows.filter("_root <> _family").select("_family").distinct()
    n = F.row_number().over(Window.partitionBy("_root").orderBy("_key"))
    plain = rows.join(numbered, "_family", "left_anti").select("_key", F.when(n == 1, F.col("_root")).otherwise(F.concat("_root", F.lit("-"), n.cast("string"))).alias("slug"))
    mixed = rows.join(numbered, "_family", "left_semi").select("_family", "_key", "_root")

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for of, own in zip(batch["_family"], batch["_root"], strict=True):
                if of != mine:
                    mine, taken, following = of, set(), {}
                slug = own
                while slug in taken:  # what was taken once stays so, so each root goes on from its last number
                    following[own] = following.get(own, 1) + 1
                    slug = f"{own}-{following[own]}"
                taken.add(slug)
                out.append(slug)
            yield pd.DataFrame({"_key": batch["_key"], "slug": out})

    kind = rows.schema["_key"].dataType.simpleString()
    given = mixed.repartition("_family").sortWithinPartitions("_family", "_key").mapInPandas(give, f"_key {kind}, slug string")
    return df.join(plain.union(given), F.col(key) == F.col("_key")).drop("_key")


def match_names(rows: DataFrame, name: str, live: DataFrame, live_name: str, live_key: str) -> DataFrame:
    """The rows with the first live entry (by key) of the same name but for case, punctuation and white space; others have null."""
    first = live.groupBy(T.contained_key(F.col(live_name)).alias("_of")).agg(F.min(live_key).alias(live_key)).filter("_of <> ''")
    return rows.join(first, T.contained_key(F.col(name)) == F.col("_of"), "left").drop("_of")


def section_changes(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """The rows whose label isn't that of the last labelled row before: a section begins there."""
    before = F.last(label, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).filter(F.col(label).isNotNull() & (F.col(label) != "") & ~F.col(label).eqNullSafe(F.col("_before"))).drop("_before")


def islands(df: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """key, island, value, first, last, size: runs of rows with equal values."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (~F.col(same).eqNullSafe(F.lag(same).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    runs = df.withColumn("_new", changed).withColumn("island", F.sum("_new").over(w))
    return runs.groupBy(key, "island").agg(F.first(same).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("size"))


def join_continuations(blocks: DataFrame, key: str, order: str, text: str, least: int = 40) -> DataFrame:
    """key, first, parts, text: a paragraph that begins in lower case continues one of at least so many characters that ends without a stop.

    Whether a block continues the one before it depends on those two only, so runs of continuations are islands.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(w)
    goes_on = F.coalesce((F.length(before) >= least) & ~F.rtrim(before).rlike(r'[.!?:"”)]$') & F.col(text).rlike(r"^\p{Ll}"), F.lit(False))
    runs = blocks.withColumn("_new", (~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(w))
    parts = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return parts.select(key, F.get("p", F.lit(0))[order].alias("first"), F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x[text]), " ").alias("text"))


LONG_PAGES = 40


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries in order; keeps the issue's last article and, before its first titled entry, how many there were and their first page."""
    columns = ["issue", "title", "start_page", "end_page", "merged", "long"]
    issue, last, leading = object(), None, None
    out: list[list] = []

    def close(at_end: bool) -> None:
        if last is not None:
            long = last[3] - last[2] + 1 > LONG_PAGES
            out.append([*last, ("back matter" if at_end else "entry lost") if long else None])

    for batch in batches:
        for r in batch.itertuples(index=False):
            title = r.title if isinstance(r.title, str) and r.title.strip() else None
            if r.issue != issue:
                close(True)
                issue, last, leading = r.issue, None, None
            if last is None or (leading and last[1] is None):
                # untitled entries before the first titled one fold into it; so far this is the one they fold into
                first, n = (min(last[2], r.start_page), last[4] + 1) if last is not None else (r.start_page, 1)
                last, leading = [r.issue, title, first, r.end_page, n], title is None
            elif title is None or title.lower() == (last[1] or "").lower() or r.start_page <= last[2]:
                last[3], last[4] = max(last[3], r.end_page), last[4] + 1
            else:
                close(False)
                last = [r.issue, title, r.start_page, r.end_page, 1]
        yield pd.DataFrame(out, columns=columns).astype({"start_page": "int64", "end_page": "int64", "merged": "int64"})
        out.clear()
    close(True)
    yield pd.DataFrame(out, columns=columns).astype({"start_page": "int64", "end_page": "int64", "merged": "int64"})


def merge_orphans(entries: DataFrame) -> DataFrame:
    """issue, title, start_page, end_page, merged, long: entries (issue, title, start_page, end_page) that are no articles fold into the one before them, by order of pages.

    Those are entries without a title, with the title of the article before but for case, or that begin no later than it does. Untitled entries before the first titled one fold into that
    one, which takes over the first page. Articles of more than ``LONG_PAGES`` pages have lost an entry after them, the issue's last one carries back matter. Starts and ends aren't null.

    What an entry is compared with depends on what was folded before, so an issue's entries pass through one task as a sorted stream, which keeps one article.
    """
    kind = entries.schema["issue"].dataType.simpleString()
    rows = entries.filter("issue IS NOT NULL").select("issue", "title", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))
    return rows.repartition("issue").sortWithinPartitions("issue", "start_page", "end_page", "title").mapInPandas(_merged, f"issue {kind}, title string, start_page long, end_page long, merged long, long string")


def glued_words(docs: DataFrame, key: str, text: str, least_letters: int = 8, least_times: int = 5) -> DataFrame:
    """word, left, right: long words that are rare, of which both halves are frequent words and follow each other somewhere. Of several
    cuts the earliest. Words, pairs and cuts are joined as tables; no list of them is gathered."""
    words = docs.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    counts = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter((F.col("n") >= least_times) & (F.length("word") >= 3)).select("word")
    rare = counts.filter((F.col("n") < least_times) & (F.length("word") >= least_letters)).select("word")
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, 1 << 30).alias("b"))).alias("p")).select("p.a", "p.b").distinct()
    cuts = rare.select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("cut"))
    cuts = cuts.select("word", "cut", F.expr("left(word, cut)").alias("a"), F.expr("substring(word, cut + 1)").alias("b"))
    good = cuts.join(frequent.withColumnRenamed("word", "a"), "a", "left_semi").join(frequent.withColumnRenamed("word", "b"), "b", "left_semi").join(pairs, ["a", "b"], "left_semi")
    return good.groupBy("word").agg(F.min_by(F.struct("a", "b"), "cut").alias("s")).select("word", F.col("s.a").alias("left"), F.col("s.b").alias("right"))


def anchors(docs: DataFrame, probes: DataFrame, key: str, text: str, probe_key: str, probe_text: str, probe_words: int = 9) -> DataFrame:
    """key, probe key, position: where the first words of a probe stand in a document, as the number of its first word.

    Both sides are cut into runs of so many words and joined on the run's text, so neither side need be broadcast; ``segments.anchored_articles`` moves a text once instead.
    """
    def normal(c: str) -> Column:
        return F.filter(F.split(T.normal_key(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")

    wanted = probes.select(probe_key, normal(probe_text).alias("w")).filter(F.size("w") >= probe_words).select(probe_key, F.array_join(F.slice("w", 1, probe_words), " ").alias("run"))
    have = docs.select(key, normal(text).alias("w")).filter(F.size("w") >= probe_words)
    runs = have.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w") - probe_words + 1)).alias("at")).select(key, "at", F.array_join(F.slice("w", F.col("at"), probe_words), " ").alias("run"))
    return runs.join(wanted, "run").groupBy(key, probe_key).agg((F.min("at") - 1).cast("long").alias("position"))


def interpolated(df: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """The rows with missing positions set between the nearest known neighbours in proportion, or to the one that there is."""
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(F.col(position).isNotNull(), F.struct(F.col(order).alias("o"), F.col(position).alias("p")))
    rows = df.withColumn("_b", F.last(known, True).over(back)).withColumn("_a", F.first(known, True).over(ahead))
    between = F.col("_b.p") + (F.col("_a.p") - F.col("_b.p")) * (F.col(order) - F.col("_b.o")) / (F.col("_a.o") - F.col("_b.o"))
    return rows.withColumn(position, F.coalesce(F.col(position).cast("double"), between, F.col("_b.p").cast("double"), F.col("_a.p").cast("double"))).drop("_a", "_b")


def chunks(df: DataFrame, start: str, end: str, size: int = 6) -> DataFrame:
    """The rows once for each chunk of pages, with chunk_start and chunk_end."""
    return df.withColumn("chunk_start", F.explode(F.sequence(F.col(start), F.col(end), F.lit(size)))).withColumn("chunk_end", F.least(F.col("chunk_start") + size - 1, F.col(end)))


def pending(items: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that the ledger doesn't have as done."""
    return items.join(ledger.select(*keys), list(keys), "left_anti")
