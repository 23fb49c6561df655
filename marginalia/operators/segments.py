"""Where the articles of an issue begin: by headings that answer to their titles, and by prose of their opening pages.

Both are folds in printed order: what an article may match depends on where the one before it was found. The rows of an issue pass
through one task as a sorted stream, Arrow batch by batch; what the task keeps is stated with each operator.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import written

#: Words that are evidence of nothing in a title.
STOP_WORDS = [
    "the", "a", "an", "of", "on", "in", "to", "for", "and", "or", "at", "by", "is", "it", "as", "with", "from", "its", "this", "that", "be", "are",
]
CONFIDENT = 0.6
SHORT_HEADING = 3
PROBE_WORDS, PROBE_PAGES, MOST_PROBES = 9, 2, 14


def title_tokens(text: Column) -> Column:
    """The distinct words of a title that aren't stop words, sorted."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]+", " "), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))))


def normal_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _title_pairs(titles: DataFrame, headings: DataFrame) -> DataFrame:
    """issue, title, heading (sets of words, written with spaces), score: all pairs of sets with a score of ``CONFIDENT`` or more.

    Score: twice the common words over the words of both; 1 if the title has all of the heading's words, three at most, and
    one of them stands in one heading only. Two sets of given sizes with that score have so many words in common that they share one among the first of each, in
    the order of how many headings have it (prefix filter). So sets meet by size on rare words; the second case meets on the word of one heading.
    """
    each = headings.select("issue", "position", F.explode("words").alias("word"))
    often = written(each.groupBy("issue", "word").agg(F.count(F.lit(1)).alias("often")), "heading-words")

    def sets(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select("issue", F.array_join("words", " ").alias(name), "words").filter(F.size("words") > 0).distinct()
        words = own.select("issue", name, F.explode("words").alias("word")).join(often, ["issue", "word"], "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(2**62)).alias("often"), "word")))  # words that no heading has come last
        return written(words.groupBy("issue", name).agg(order.alias("words")).withColumn("id", F.monotonically_increasing_id()), f"{name}-sets")

    a, b = sets(titles, "title"), sets(headings, "heading")
    size, most = F.size("words"), b.agg(F.max(F.size("words"))).first()[0] or 0
    low, high = CONFIDENT / (2 - CONFIDENT), (2 - CONFIDENT) / CONFIDENT  # of two sets with that score none is smaller or larger by more
    # a title looks among headings of each size that it may match for the first of its words that it can't do without; headings are found by all that any title can't do without
    sizes = F.sequence(F.ceil(size * F.lit(low) - 1e-9).cast("int"), F.least(F.lit(most), F.floor(size * F.lit(high) + 1e-9).cast("int")))
    wide = a.filter(F.ceil(size * F.lit(low) - 1e-9) <= most).select("issue", "id", F.col("words.word").alias("words"), F.explode(sizes).alias("other"))
    need = F.ceil((F.size("words") + F.col("other")) * F.lit(CONFIDENT / 2) - 1e-9).cast("int")
    wide = wide.select("issue", "id", "other", F.explode(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.size("words") - need + 1))).alias("word"))
    asked = wide.select(F.xxhash64("issue", "word", "other").alias("key"), F.col("id").alias("title_id"))
    kept = F.slice("words", F.lit(1), size - F.ceil(size * F.lit(low) - 1e-9).cast("int") + 1)
    held = b.select("issue", "id", size.alias("other"), F.explode(kept).alias("w")).select(F.xxhash64("issue", "w.word", "other").alias("key"), F.col("id").alias("heading_id"))
    short = b.filter((size <= SHORT_HEADING) & (F.get("words", F.lit(0)).often == 1)).select(F.xxhash64("issue", F.get("words", F.lit(0)).word).alias("key"), F.col("id").alias("heading_id"))
    any_word = a.select("issue", "id", F.explode("words").alias("w")).select(F.xxhash64("issue", "w.word").alias("key"), F.col("id").alias("title_id"))
    pairs = asked.join(held, "key").select("title_id", "heading_id").unionByName(any_word.join(short, "key").select("title_id", "heading_id")).distinct()
    # hashes only bring pairs together; what holds is said by the sets
    left = a.select(F.col("id").alias("title_id"), "issue", "title", F.col("words.word").alias("t"))
    right = b.select(F.col("id").alias("heading_id"), F.col("issue").alias("_issue"), "heading", F.col("words.word").alias("h"), (F.get("words", F.lit(0)).often == 1).alias("_rare"))
    rows = pairs.join(left, "title_id").join(right, "heading_id").filter("issue = _issue").withColumn("_common", F.size(F.array_intersect("t", "h")))
    whole = F.col("_rare") & (F.size("h") <= SHORT_HEADING) & (F.col("_common") == F.size("h"))
    score = F.when(whole, 1.0).otherwise(F.round(2 * F.col("_common") / (F.size("t") + F.size("h")), 9))
    return rows.select("issue", "title", "heading", score.alias("score")).filter(F.col("score") >= CONFIDENT)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by issue: first places of headings, then entries with their candidates. Keeps an issue's places of candidates with their texts, and the floor."""
    issue, places, floor, entry, best = object(), {}, 0, None, None
    out: list[tuple] = []

    def close() -> None:
        nonlocal floor, entry
        if entry is not None and best is not None:
            out.append((issue, entry, best[1], best[2], -best[0]))
            floor = best[1] + 1
        entry = None

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        rows = out[:]
        out.clear()
        names, types = ["issue", "entry", "position", "text", "score"], [schema.field("issue").type, schema.field("entry").type, pa.int64(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    schema = None
    for batch in batches:
        schema = batch.schema
        for r in batch.to_pylist():
            if r["issue"] != issue:
                close()
                issue, places, floor = r["issue"], {}, 0
            if r["entry"] is None:
                places.setdefault(r["heading"], []).append((r["position"], r["text"]))
                continue
            if r["entry"] != entry:
                close()
                entry, best = r["entry"], None
            own = places.get(r["heading"], ())
            at = bisect_left(own, (floor,))
            if at < len(own) and (best is None or (-r["score"], own[at][0]) < best[:2]):
                best = (-r["score"], *own[at])
        if len(out) >= 10_000:
            yield flush(schema)
    close()
    if schema is not None:
        yield flush(schema)


def heading_segments(elements: DataFrame, articles: DataFrame) -> DataFrame:
    """Per article (issue, entry, title, skip): start and end (positions of elements), matched_heading, score, confident.

    elements: issue, position, kind, text. In the order of entries, an article begins at the heading of best score at or after the
    end of the last match, of equals the first; the best must have ``CONFIDENT``. It ends before the next article that begins, the
    last one with the issue. Skipped entries match nothing and move nothing; entries without a match have nulls and score 0.
    (issue, entry) and (issue, position) are unique; null texts and titles have no words.

    At scale: sets of words are compared once, however often a heading or title occurs. A task keeps the places of an issue's
    headings that are candidates of some title, not its elements.
    """
    headings = elements.filter("kind = 'heading'").select("issue", F.col("position").cast("long").alias("position"), "text", title_tokens(F.col("text")).alias("words"))
    headings = written(headings, "headings")
    asked = articles.filter(~F.coalesce("skip", F.lit(False))).select("issue", "entry", title_tokens(F.col("title")).alias("words"))
    pairs = written(_title_pairs(asked, headings), "title-pairs")
    places = headings.select("issue", F.array_join("words", " ").alias("heading"), "position", "text").join(pairs.select("issue", "heading").distinct(), ["issue", "heading"], "left_semi")
    wanted = asked.select("issue", "entry", F.array_join("words", " ").alias("title")).join(pairs, ["issue", "title"]).select("issue", "entry", "heading", "score")
    rows = places.withColumns({"entry": F.lit(None).cast(articles.schema["entry"].dataType), "score": F.lit(None).cast("double")}).unionByName(wanted, allowMissingColumns=True)
    kinds = [f"{c} {articles.schema[c].dataType.simpleString()}" for c in ("issue", "entry")]
    found = rows.repartition("issue").sortWithinPartitions("issue", F.asc_nulls_first("entry"), "position").mapInArrow(_pick, f"{', '.join(kinds)}, position long, text string, score double")
    following = F.lead("position").over(Window.partitionBy("issue").orderBy("entry"))
    sizes = elements.groupBy("issue").agg(F.count(F.lit(1)).alias("_n"))
    found = found.withColumn("_next", following).join(sizes, "issue").withColumn("end", F.coalesce("_next", "_n") - 1)
    out = articles.select("issue", "entry", "title", "skip").join(found.withColumnRenamed("text", "matched_heading"), ["issue", "entry"], "left")
    return out.select("issue", "entry", "title", "skip", F.col("position").alias("start"), "end", "matched_heading", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("position").isNotNull().alias("confident"))


class _Prose:
    """An issue's elements as a stream of words, and where its probes stand in them.

    A probe may begin inside a word and end inside one, as a search in the joined text would find it: its middle words are whole words there.
    """

    def __init__(self):
        self.middle: dict[str, list] = {}
        self.second: set[str] = set()
        self.hits: dict[str, list] = {}
        self.tail: deque = deque(maxlen=PROBE_WORDS - 1)
        self.words = 0

    def look_for(self, probe: str) -> None:
        if probe not in self.hits:
            words = probe.split(" ")
            self.hits[probe] = []
            self.second.add(words[1])
            self.middle.setdefault(" ".join(words[1:-1]), []).append((words[0], words[-1], probe))

    def read(self, element: int, text: str) -> None:
        words = text.split(" ") if text else []
        if not self.middle:
            return
        end = self.words + len(words)
        begun = [*self.tail, *((w, element, end) for w in words)]
        first = self.words - len(self.tail)
        for i in range(len(begun) - PROBE_WORDS + 1):
            if begun[i + 1][0] in self.second:
                last = begun[i + PROBE_WORDS - 1][0]
                for head, foot, probe in self.middle.get(" ".join([w for w, _, _ in begun[i + 1 : i + PROBE_WORDS - 1]]), ()):
                    word, at, ends = begun[i]
                    if word.endswith(head) and last.startswith(foot):
                        self.hits[probe].append((first + i, len(word) - len(head), at, ends))
        self.tail.extend(begun[-(PROBE_WORDS - 1) :] if len(words) >= PROBE_WORDS - 1 else begun[len(self.tail) :])
        self.words = end


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by issue: probes, then elements in order, then entries in order."""
    names = ["issue", "entry", "position", "end_position", "probe", "probes_matched", "probes_tried", "confident", "estimated"]
    out: list[tuple] = []
    issue, prose, floor, n_elements, waiting, last, before = object(), None, 0, 0, [], None, None

    def emit(row: dict, end: int | None) -> None:
        out.append((issue, row["entry"], row["position"], end, row["probe"], row["matched"], row["tried"], row["probe"] is not None, row["probe"] is None and row["position"] is not None))

    def put(row: dict) -> None:
        nonlocal last, before
        if last is not None:
            emit(last, row["position"] - 1)
        last, before = row, (row["position"], row["page"])

    def close() -> None:
        nonlocal last, before
        if last is not None:
            emit(last, n_elements - 1)
        for row in waiting:
            emit(row, None)
        waiting.clear()
        last = before = None

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        rows = out[:]
        out.clear()
        types = [schema.field("issue").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def article(entry: int, page: int | None, probes: list[str]) -> None:
        nonlocal floor
        first, matched = None, 0
        for k, probe in enumerate(probes):
            hits = prose.hits[probe]
            at = bisect_left(hits, (floor,))
            if at < len(hits):
                matched += 1
                word, offset, element, ends = hits[at]
                if first is None or (word, offset, k) < first[:3]:
                    first = (word, offset, k, element, ends, probe)
        row = {"entry": entry, "page": page, "position": None, "probe": None, "matched": matched, "tried": len(probes)}
        if first is None:
            waiting.append(row) if before is not None else emit(row, None)
            return
        row |= {"position": first[3], "probe": first[5]}
        for own in waiting:
            low, high = before[0], row["position"]
            known = page is not None and before[1] is not None and own["page"] is not None and page > before[1]
            share = (own["page"] - before[1]) / (page - before[1]) if known else 0.5
            own["position"] = min(max(math.floor(low + share * (high - low) + 0.5), low + 1), high - 1)
            put(own)
        waiting.clear()
        put(row)
        floor = first[4]

    schema = None
    for batch in batches:
        schema = batch.schema
        for r in batch.to_pylist():
            if r["issue"] != issue:
                close()
                issue, prose, floor, n_elements = r["issue"], _Prose(), 0, 0
            if r["kind"] == 0:
                prose.look_for(r["text"])
            elif r["kind"] == 1:
                prose.read(n_elements, r["text"])
                n_elements += 1
            else:
                article(r["number"], r["page"], r["probes"])
        if len(out) >= 10_000:
            yield flush(schema)
    close()
    if schema is not None:
        yield flush(schema)


def page_probes(text: Column) -> Column:
    """The first nine words of each line of a page that has so many, distinct, in order, ``MOST_PROBES`` at most."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.split(normal_words(x), " "))
    probes = F.transform(F.filter(lines, lambda w: F.size(w) >= PROBE_WORDS), lambda w: F.array_join(F.slice(w, 1, PROBE_WORDS), " "))
    return F.slice(F.array_distinct(probes), 1, MOST_PROBES)


def opening_probes(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """The articles (issue, entry, start_page, end_page) with probes: the distinct ones of their first two pages (issue, page, probes), ``MOST_PROBES`` at most."""
    own = pages.select("issue", F.col("page").alias("_page"), F.col("probes").alias("_probes"))
    out, parts = articles, []
    for k in range(PROBE_PAGES):
        page = F.when(F.col("start_page") + k <= F.col("end_page"), F.col("start_page") + k)
        out = out.withColumn("_page", page).join(own.withColumnRenamed("_probes", f"_probes{k}"), ["issue", "_page"], "left").drop("_page")
        parts.append(F.coalesce(f"_probes{k}", F.array().cast("array<string>")))
    return out.withColumn("probes", F.slice(F.array_distinct(F.concat(*parts)), 1, MOST_PROBES)).drop(*(f"_probes{k}" for k in range(PROBE_PAGES)))


def anchored_articles(elements: DataFrame, articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Per article (issue, entry, start_page, end_page): position and end_position (of elements), probe, probes_matched, probes_tried, confident, estimated.

    elements: issue, position, text; their places are numbered from 0 in the order of position, which may be of any type that sorts. In the order of entries, an article begins at the element where the earliest of its probes stands
    at or after the floor, which then moves behind that element. Articles without a hit are placed between their neighbours
    in proportion to their pages, between the two positions; before the first and after the last hit they have none. An article
    ends before the next one that has a place, the last one with the issue. pages: issue, page, and probes, which ``page_probes`` makes of a page's text.
    (issue, entry), (issue, position) and (issue, page) are unique; null texts have no words.

    At scale: the text of elements is shuffled once, and read once as a stream of words against an issue's probes. A task keeps an
    issue's probes, their hits, and its articles without a place since the last hit.
    """
    kind = articles.schema["issue"].dataType.simpleString()
    asked = opening_probes(articles.select("issue", F.col("entry").cast("long").alias("entry"), "start_page", "end_page"), pages)
    empty = F.lit(None).cast("array<string>")
    none, place = F.lit(None).cast("long"), elements.schema["position"].dataType
    unplaced = F.lit(None).cast(place).alias("place")
    probes = asked.select("issue", F.explode("probes").alias("text")).distinct().select("issue", F.lit(0).alias("kind"), none.alias("number"), unplaced, none.alias("page"), "text", empty.alias("probes"))
    flow = elements.select("issue", F.lit(1).alias("kind"), none.alias("number"), F.col("position").alias("place"), none.alias("page"), normal_words(F.col("text")).alias("text"), empty.alias("probes"))
    entries = asked.select("issue", F.lit(2).alias("kind"), F.col("entry").alias("number"), unplaced, F.col("start_page").cast("long").alias("page"), F.lit(None).cast("string").alias("text"), "probes")
    rows = probes.unionByName(flow).unionByName(entries).repartition("issue").sortWithinPartitions("issue", "kind", "place", "number").drop("place")
    return rows.mapInArrow(_place, f"issue {kind}, entry long, position long, end_position long, probe string, probes_matched long, probes_tried long, confident boolean, estimated boolean")


def prose_problems(elements: DataFrame, segments: DataFrame) -> DataFrame:
    """issue, position, entry, kind, text: paragraphs inside an article that open in lower case. If the text element before them (of any article; tables
    and blank ones are passed over) doesn't end its sentence, they are an orphan-fragment, else a dropped-capital.

    elements: issue, position, kind, text; segments: issue, entry, start, end, skip, not overlapping. Texts are trimmed and given up to 90 characters.

    At scale: one sort of each issue's elements and segment starts together carries the last start along, and whether the last text was finished; whole texts aren't moved.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    entry, place = segments.schema["entry"].dataType, elements.schema["position"].dataType
    texts = elements.filter(F.col("kind") != "table").select("issue", "position", "kind", text.alias("_text")).filter("_text <> ''")
    opens = (F.col("kind") == "paragraph") & F.col("_text").rlike("^[a-z]")
    flow = texts.select("issue", "position", F.lit(1).alias("_side"), F.when(opens, F.substring("_text", 1, 90)).alias("text"), (~F.col("_text").rlike("[.!?:;”\"’')\\]]$")).alias("_open"), F.lit(None).cast(entry).alias("_entry"), F.lit(None).cast("long").alias("_end"))
    begins = segments.filter(~F.coalesce("skip", F.lit(False)) & F.col("start").isNotNull()).select("issue", F.col("start").cast(place).alias("position"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("_open"), F.col("entry").alias("_entry"), F.col("end").cast("long").alias("_end"))
    so_far = Window.partitionBy("issue").orderBy("position", "_side").rowsBetween(Window.unboundedPreceding, -1)
    rows = flow.unionByName(begins).withColumns({
        "_own": F.last(F.when(F.col("_entry").isNotNull(), F.struct("_entry", "_end")), True).over(so_far),
        "_before": F.last("_open", True).over(so_far),
    }).filter("_side = 1 AND text IS NOT NULL")
    rows = rows.filter(F.coalesce(F.col("position") <= F.col("_own._end"), F.lit(False)))
    return rows.select("issue", "position", F.col("_own._entry").alias("entry"), F.when(F.col("_before"), "orphan-fragment").otherwise("dropped-capital").alias("kind"), "text")
