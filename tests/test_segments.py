"""Heading and prose segmentation against plain folds, on small vocabularies with many repeated lines."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.operators import segments as S


def tokens(text):
    return {w for w in re.sub(r"[^a-z0-9\s]+", " ", (text or "").lower()).split() if w not in S.STOP_WORDS}


def plain_headings(elements, articles):
    heads = [(p, t, tokens(t)) for p, k, t in elements if k == "heading"]
    alone = [w for w in set().union(*(h for _, _, h in heads)) if sum(w in h for _, _, h in heads) == 1] if heads else []
    floor, found = 0, []
    for entry, title, skip in articles:
        best = (0, None, None)
        for p, text, h in heads if not skip else []:
            t = tokens(title)
            common = len(t & h)
            if p < floor or not common:
                continue
            score = 1.0 if h <= t and len(h) <= 3 and h & set(alone) else 2 * common / (len(t) + len(h))
            if score > best[0] + 1e-9:
                best = (score, p, text)
        if best[0] >= 0.6:
            found.append((entry, *best))
            floor = best[1] + 1
        else:
            found.append((entry, 0.0, None, None))
    starts = [p for _, _, p, _ in found if p is not None] + [len(elements)]
    return {e: (p, starts[starts.index(p) + 1] - 1 if p is not None else None, t, round(s, 6)) for e, s, p, t in found}


@pytest.mark.parametrize("seed", range(3))
def test_headings_equal_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["grid", "solar", "tariff", "the", "of", "wind", "rules", "x1", "x2", "x3", "x4", "x5"]
    phrase = lambda most: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, most)))
    elements, articles = [], []
    for issue in ("a", "b", None):
        elements += [(issue, p, rng.choice(["heading", "heading", "paragraph"]), rng.choice([phrase(5), phrase(9), None])) for p in range(60)]
        articles += [(issue, e, rng.choice([phrase(6), None]), rng.random() < 0.1) for e in range(25)]
    a = spark.createDataFrame(elements, "issue string, position long, kind string, text string").repartition(5)
    b = spark.createDataFrame(articles, "issue string, entry long, title string, skip boolean")
    got = S.heading_segments(a, b).collect()
    for issue in ("a", "b"):
        want = plain_headings([r[1:] for r in elements if r[0] == issue], [r[1:] for r in articles if r[0] == issue])
        assert {r.entry: (r.start, r.end, r.matched_heading, round(r.score, 6)) for r in got if r.issue == issue} == want
    assert sum(r.confident for r in got) > 5
    assert S.heading_segments(a.limit(0), b).filter("confident").count() == 0


def plain_anchors(elements, articles, pages):
    normal = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()
    hay, marks = "", []
    for p, t in enumerate(elements):
        if normal(t):
            marks.append((len(hay), p))
            hay += normal(t) + " "
    out, floor = [], 0
    for entry, first, last in articles:
        probes = []
        for page in range(first, min(last, first + 1) + 1):
            for line in (pages.get(page) or "").split("\n"):
                words = normal(line).split()
                if len(words) >= 9 and " ".join(words[:9]) not in probes:
                    probes.append(" ".join(words[:9]))
        probes = probes[:14]
        hits = [(hay.find(x, floor), k) for k, x in enumerate(probes) if hay.find(x, floor) >= 0]
        row = [entry, None, None, None, len(hits), len(probes), False, first]
        if hits:
            at, k = min(hits)
            i = max(i for i, (o, _) in enumerate(marks) if o <= at)
            row[1], row[3], row[6] = marks[i][1], probes[k], True
            floor = marks[i + 1][0] if i + 1 < len(marks) else len(hay)
        out.append(row)
    for i, row in enumerate(out):
        before, after = [r for r in out[:i] if r[1] is not None], [r for r in out[i + 1 :] if r[1] is not None]
        if row[1] is None and before and after:
            b, a = before[-1], after[0]
            share = (row[7] - b[7]) / (a[7] - b[7]) if a[7] > b[7] else 0.5
            row[1] = min(max(math.floor(b[1] + share * (a[1] - b[1]) + 0.5), b[1] + 1), a[1] - 1)
    placed = [r for r in out if r[1] is not None]
    for r, following in zip(placed, [*placed[1:], None], strict=True):
        r[2] = (following[1] if following else len(elements)) - 1
    return {r[0]: (*r[1:7], r[1] is not None and not r[6]) for r in out}


@pytest.mark.parametrize("seed", range(3))
def test_anchors_equal_a_search_in_the_joined_text(spark, seed):
    rng = random.Random(seed)
    words = ["a", "ba", "cba", "b", "Über", "x"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 12))) for _ in range(12)]
    elements, articles, pages = [], [], []
    for issue in ("i", "j"):
        texts = [rng.choice([*lines, "", None, rng.choice(lines)[1:]]) for _ in range(80)]
        own = {p: rng.choice([None, "", "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 4)))]) for p in range(1, 20)}
        elements += [(issue, p, t) for p, t in enumerate(texts)]
        pages += [(issue, p, t) for p, t in own.items()]
        articles += [(issue, e, e + 1 - e % 2, e + 1 + e % 3) for e in range(18)]
    a = spark.createDataFrame(elements, "issue string, position long, text string").repartition(5)
    b = spark.createDataFrame(articles, "issue string, entry long, start_page long, end_page long")
    c = spark.createDataFrame(pages, "issue string, page long, text string").select("issue", "page", S.page_probes(F.col("text")).alias("probes"))
    got = S.anchored_articles(a, b, c).collect()
    for issue in ("i", "j"):
        want = plain_anchors([r[2] for r in elements if r[0] == issue], [r[1:] for r in articles if r[0] == issue], {r[1]: r[2] for r in pages if r[0] == issue})
        assert {r.entry: tuple(r)[2:] for r in got if r.issue == issue} == want
    assert sum(r.confident for r in got) > 5 and sum(r.estimated for r in got) > 0
    assert S.anchored_articles(a.limit(0), b, c).filter("position IS NOT NULL").count() == 0


def test_an_issue_of_a_hundred_thousand_entries_is_a_stream(spark):
    n = 100_000
    elements = spark.range(n).selectExpr("'i' AS issue", "id AS position", "'heading' AS kind", "concat('title x', id % 50000) AS text")
    articles = spark.range(n).selectExpr("'i' AS issue", "id AS entry", "concat('Title of X', id % 50000) AS title", "false AS skip")
    got = S.heading_segments(elements, articles)
    assert got.filter("confident AND start = entry AND end = entry").count() == n


def test_prose_problems(spark):
    texts = [("paragraph", "Opens well."), ("paragraph", "goes on"), ("table", "x"), ("paragraph", " "), ("paragraph", "and on"), ("heading", "small"), ("paragraph", "after a heading"), ("paragraph", "outside")]
    elements = spark.createDataFrame([("i", p, k, t) for p, (k, t) in enumerate(texts)], "issue string, position long, kind string, text string")
    segments = spark.createDataFrame([("i", 1, 1, 6, False), ("i", 2, 7, 7, True)], "issue string, entry long, start long, end long, skip boolean")
    got = sorted((r.position, r.entry, r.kind) for r in S.prose_problems(elements, segments).collect())
    assert got == [(1, 1, "dropped-capital"), (4, 1, "orphan-fragment"), (6, 1, "orphan-fragment")]
