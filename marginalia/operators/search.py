"""Weighted full-text search as column expressions over word arrays.

A search is one pass over the documents: match and score are expressions inside the scan's stage, and only the best k
rows of each task are sorted. Ranks use term counts only, so no statistics of the corpus are needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of fields of the classes A to D, times ten, so that scores are whole numbers.
WEIGHTS = {"A": 10, "B": 4, "C": 2, "D": 1}
MOST_HITS = 3


@dataclass
class Query:
    """Groups of which all must match; a group matches if one of its phrases does. ``none``: phrases that mustn't occur."""

    groups: list[list[tuple[str, ...]]] = field(default_factory=list)
    none: list[tuple[str, ...]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(w for g in self.groups for p in g for w in p))


def parse(text: str) -> Query:
    """Web search syntax: bare words are all required, "quoted words" are a phrase, ``or`` joins its neighbours, - excludes."""
    out, joining = Query(), False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            joining = bool(out.groups)
            continue
        words = tuple(re.findall("[a-z]+", phrase or word))
        if not words:
            continue
        if minus:
            out.none.append(words)
        elif joining:
            out.groups[-1].append(words)
        else:
            out.groups.append([words])
        joining = False
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def indexed(docs: DataFrame, fields: dict[str, tuple[Column, str]], stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """Documents with a word array for each field: {name: (text, class of weight)}. ``stem`` is applied to each word."""
    return docs.withColumns({f"_w_{n}": F.transform(words_of(c), stem) if stem else words_of(c) for n, (c, _) in fields.items()})


def _holds(fields: dict, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return reduce(Column.__or__, (F.array_contains(f"_w_{n}", phrase[0]) for n in fields))
    wanted = f" {' '.join(phrase)} "
    return reduce(Column.__or__, (F.contains(F.concat(F.lit(" "), F.array_join(f"_w_{n}", " "), F.lit(" ")), F.lit(wanted)) for n in fields))


def matching(docs: DataFrame, fields: dict[str, tuple[Column, str]], query: Query) -> DataFrame:
    """The documents that match; a query without required words matches nothing."""
    if not query.groups:
        return docs.filter(F.lit(False))
    wanted = reduce(Column.__and__, (reduce(Column.__or__, (_holds(fields, p) for p in g)) for g in query.groups))
    return docs.filter(reduce(lambda a, p: a & ~_holds(fields, p), query.none, wanted))


def score(fields: dict[str, tuple[Column, str]], query: Query) -> Column:
    """Per field and term, its occurrences up to three, times the field's weight."""
    each = []
    for name, (_, weight) in fields.items():
        for term in query.terms:
            found = F.size(F.filter(f"_w_{name}", _equals(term)))
            each.append(F.least(found, F.lit(MOST_HITS)) * WEIGHTS[weight])
    return reduce(Column.__add__, each).cast("long")


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def ranked(docs: DataFrame, fields: dict[str, tuple[Column, str]], text: str, key: str, limit: int = 20) -> DataFrame:
    """The best matches with their score, ties by key."""
    query = parse(text)
    found = matching(indexed(docs, fields), fields, query)
    out = found.withColumn("score", score(fields, query) if query.terms else F.lit(0).cast("long"))
    return out.drop(*(f"_w_{n}" for n in fields)).orderBy(F.desc("score"), key).limit(limit)


def hydrated(found: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The rows of the documents found, with their score and place. Only what ``ranked`` left, limit rows at most, is numbered."""
    placed = found.select(key, "score").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))
    return docs.join(placed, key)


def snippet(text: Column, query: Query, before: int = 8, most: int = 40) -> Column:
    """So many words around the first one that the query has, hits in <b>; the first words if it has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hit = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "").isin(query.terms)
    places = F.transform(words, hit)
    start = F.greatest(F.lit(1), F.array_position(places, True).cast("int") - before)
    return F.array_join(F.transform(F.slice(words, start, most), lambda w: F.when(hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")
