"""Stems by known examples, and matching and ranking against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import stems as W
from marginalia.operators import postings as S

STEMS = {
    "consigned": "consign", "consistently": "consist", "consolation": "consol", "knackeries": "knackeri", "knightly": "knight", "waste": "wast", "policies": "polici", "generation": "generat", "general": "general",
    "communism": "communism", "hopping": "hop", "hoped": "hope", "happy": "happi", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "agreed": "agre", "relational": "relat", "conditional": "condit",
    "rationalize": "ration", "electricity": "electr", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "regulations": "regul", "skies": "sky", "dying": "die", "rolled": "roll", "rate": "rate",
    "analogies": "analog", "succeed": "succeed", "enjoy": "enjoy", "boyish": "boyish", "formality": "formal", "énergie": "énergie", "2021": "2021", "x1": "x1", "it": "it",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert W.stem(word) == STEMS[word]


def test_stems_are_taken_of_distinct_words(spark):
    words = spark.createDataFrame([(w,) for w in (*STEMS, None)], "word string")
    assert {r.word: r.term for r in W.stems(words).collect()} == STEMS


def plain(docs, text):
    """Places by term, and the documents that match with their ranks; each written anew from the rules."""
    query = S.parse(text)
    out = {}
    for key, title, body in docs:
        places, shift = {}, 0
        for field, weight in ((title, 1.0), (body, 0.4)):
            words = re.findall(r"[^\W_]+", (field or "").lower())
            kept = [(i + 1, w) for i, w in enumerate(words) if w not in W.STOP_WORDS]
            for i, w in kept:
                places.setdefault(W.stem(w), []).append((i + shift, weight))
            shift += kept[-1][0] if kept else 0
        holds = lambda p: any(all(any(q == s + step for q, _ in places.get(t, [])) for t, step in zip(p.terms, p.steps, strict=True)) for s, _ in places.get(p.terms[0], []))  # noqa: B023, E731
        if not query.groups or not all(any(map(holds, g)) for g in query.groups) or any(map(holds, query.none)):
            continue
        terms = query.terms
        if len(terms) > 1 and (len(query.groups) > 1 or len(query.groups[0]) == 1):
            left = 1.0
            for i, a in enumerate(terms):
                for b in terms[:i]:
                    for p, g in places.get(a, []):
                        for q, h in places.get(b, []):
                            if p != q:
                                left *= 1 - math.sqrt(g * h * (1e-30 if abs(p - q) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))))
            out[key] = 1 - left if left < 1 else 1e-20
        else:
            total = 0.0
            for t in terms:
                own = [g for _, g in sorted(places.get(t, []))]
                if own:
                    at = own.index(max(own))
                    total += (max(own) + sum(g / (i + 1) ** 2 for i, g in enumerate(own)) - max(own) / (at + 1) ** 2) / S.INVERSE_SQUARES
            out[key] = total / len(terms)
    return out


@pytest.mark.parametrize("text", ["solar policy", 'roof or "solar panels" -waste', "énergie 2021", '"the policy of roofs"', "policies or wastes", "nothing", "the of", '-solar', "solar solar"])
def test_search_equals_the_plain_version(spark, text):
    rng = random.Random(11)
    words = ["solar", "Solar", "panel", "panels", "policy", "Policies,", "the", "of", "roof", "roofs", "waste", "énergie", "2021", "x"]
    phrase = lambda most: rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))])
    docs = [(k, phrase(6), phrase(130)) for k in range(120)]
    df = spark.createDataFrame(docs, "id long, title string, body string").repartition(4)
    index = S.index_of(df, "id", [(F.col("title"), "A"), (F.col("body"), "B")])
    got = {r.id: r["rank"] for r in S.found(index, S.parse(text), "id").collect()}
    want = plain(docs, text)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got)
    assert text not in ("solar policy", "énergie 2021", "policies or wastes") or got


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, title string")
    assert S.found(S.index_of(df, "id", [(F.col("title"), "A")]), S.parse("x"), "id").count() == 0


def test_a_search_moves_the_places_of_its_terms_only(spark):
    df = spark.createDataFrame([(1, "Roofs of solar panels"), (2, "policies"), (3, None)], "id long, title string")
    hits = S.found(S.index_of(df, "id", [(F.col("title"), "A")]), S.parse("panel or policy"), "id")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Filter" in plan[: plan.index("MapInArrow")].split("Aggregate [")[-1]
    assert {r.id for r in hits.collect()} == {1, 2}
