"""Full-text search over an index of postings: where each term stands in each document, with the class of its field.

Words are letters and digits of any script in lower case; stop words aren't indexed but keep their places. The rank weighs how close the terms of a query stand to each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import stems
from marginalia.functions.stems import STOP_WORDS, stem

#: Weights of the classes A to D; the most places of a term in a document that the rank looks at, and the last place; how nearness counts.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
MOST_PLACES, LAST_PLACE, FAR = 256, 16383, 100
WORD = r"[\p{L}\p{N}]+"
INVERSE_SQUARES = 1.64493406685  # the sum of 1/i² over all i


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def index_of(docs: DataFrame, key: str, fields: list[tuple[Column, str]], stemmed: bool = True) -> DataFrame:
    """term, key, places (array of place, weight, by place): of the fields (text, class A to D) in this order, whose places go on from each other's last indexed one.

    At scale: words meet their stems in the tasks that read the texts, so each place is moved once, by term and key. A search on an index that isn't written moves the places of its terms only:
    its filter goes below the grouping. The index is partitioned by nothing: write it sorted or bucketed by term, and a search reads its terms only.
    """
    kept = lambda w: ~w.isin(*STOP_WORDS)
    rows, before, each = docs, F.lit(0), []
    for k, (text, weight) in enumerate(fields):
        rows = rows.withColumn(f"_w{k}", F.filter(F.transform(words_of(text), lambda w, i: F.struct((i + 1).alias("place"), w.alias("word"))), lambda x: kept(x.word)))
        each.append(_shifted(f"_w{k}", before, weight))
        before = before + F.coalesce(F.get(f"_w{k}", F.size(f"_w{k}") - 1).place, F.lit(0))
    found = rows.select(key, F.explode(F.concat(*each)).alias("x")).select(F.col("x.word").alias("term"), key, "x.place", "x.weight")
    if stemmed:
        found = stems.stemmed(found.withColumnRenamed("term", "_word"), "_word").drop("_word")
    return found.groupBy("term", key).agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("places"))


def _shifted(words: str, shift: Column, weight: str) -> Column:
    return F.transform(words, lambda x: F.struct(F.least(x.place + shift, F.lit(LAST_PLACE)).alias("place"), F.lit(WEIGHTS[weight]).alias("weight"), x.word.alias("word")))


class Phrase(NamedTuple):
    """Terms and how far each stands behind the first."""

    terms: tuple[str, ...]
    steps: tuple[int, ...]


class Query(NamedTuple):
    """All groups must match; a group does if one of its phrases does. What is in ``none`` mustn't occur."""

    groups: list[list[Phrase]]
    none: list[Phrase]

    @property
    def terms(self) -> list[str]:
        return sorted({t for g in self.groups for p in g for t in p.terms})


def parse(text: str, stemmed: bool = True) -> Query:
    """Web search syntax: bare words are all required, "quoted words" follow each other, ``or`` joins its neighbours, - excludes. Stop words are passed over; in a phrase they keep their places."""
    out, joining = Query([], []), False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            joining = bool(out.groups)
            continue
        words = re.findall(r"[^\W_]+", phrase or word)
        kept = [(i, stem(w) if stemmed else w) for i, w in enumerate(words) if w not in STOP_WORDS]
        if not kept:
            continue
        own = Phrase(tuple(w for _, w in kept), tuple(i - kept[0][0] for i, _ in kept))
        if minus:
            out.none.append(own)
        elif joining:
            out.groups[-1].append(own)
        else:
            out.groups.append([own])
        joining = False
    return out


def _places(term: str) -> Column:
    return F.coalesce(F.try_element_at("_terms", F.lit(term)), F.array().cast("array<struct<place:int,weight:double>>"))


def _holds(phrase: Phrase) -> Column:
    at = lambda term: F.transform(_places(term), lambda p: p.place)
    if len(phrase.terms) == 1:
        return F.size(_places(phrase.terms[0])) > 0
    starts = at(phrase.terms[0])
    for term, step in zip(phrase.terms[1:], phrase.steps[1:], strict=True):
        starts = F.array_intersect(starts, F.transform(at(term), _less(step)))
    return F.size(starts) > 0


def _less(step: int) -> Callable[[Column], Column]:
    return lambda p: p - step


def _first_max(places: Column) -> Column:
    """The rank of one term: its weights over the squares of their numbers, but the greatest in full."""
    weights = F.transform(places, lambda p: p.weight)
    total = F.aggregate(F.transform(weights, lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, x: a + x)
    most = F.array_max(weights)
    at = F.array_position(weights, most)
    return F.coalesce((most + total - most / (at * at)) / INVERSE_SQUARES, F.lit(0.0))


def _near(a: Column, b: Column) -> Column:
    """What the pairs of places of two terms leave of 1: each takes away the root of both weights and their nearness."""
    def nearness(x: Column, y: Column) -> Column:
        apart = F.abs(x.place - y.place)
        near = F.when(apart > FAR, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(apart / 1.5 - 2)))
        return F.when(apart > 0, 1.0 - F.sqrt(x.weight * y.weight * near)).otherwise(F.lit(1.0))

    return F.aggregate(a, F.lit(1.0), lambda acc, x: acc * F.aggregate(b, F.lit(1.0), lambda inner, y: inner * nearness(x, y)))


def rank(query: Query) -> Column:
    """Of several terms that are all required, how near they stand; else the mean of their single ranks."""
    own = {t: F.slice(_places(t), 1, MOST_PLACES) for t in query.terms}
    terms = list(own)
    required = len(terms) > 1 and (len(query.groups) > 1 or len(query.groups[0]) == 1)
    if not required:
        return reduce(Column.__add__, (_first_max(own[t]) for t in terms)) / len(terms)
    left = reduce(Column.__mul__, (_near(own[a], own[b]) for i, a in enumerate(terms) for b in terms[:i]))
    return F.when(left < 1.0, 1.0 - left).otherwise(F.lit(1e-20))


def found(index: DataFrame, query: Query, key: str) -> DataFrame:
    """key, rank of the documents that match. Only postings of the query's terms are read; a query without required words matches nothing.

    At scale: postings of a query's terms are grouped by document, so a frequent term is spread over documents; a group holds one document's places.
    """
    if not query.groups:
        return index.select(key).limit(0).withColumn("rank", F.lit(0.0))
    wanted = sorted({*query.terms, *(t for p in query.none for t in p.terms)})
    docs = index.filter(F.col("term").isin(*wanted)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_terms"))
    match = reduce(Column.__and__, (reduce(Column.__or__, map(_holds, g)) for g in query.groups))
    match = reduce(lambda a, p: a & ~_holds(p), query.none, match)
    return docs.filter(match).select(key, rank(query).alias("rank"))
