"""Runs against every stretch tried one by one, the Lyndon array against its definition, and odd tables."""

import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import runs


def plain_runs(words, least):
    out, n = [], len(words)
    for start in range(n):
        for p in range(1, n - start):
            if start and start - 1 + p < n and words[start - 1] == words[start - 1 + p]:
                continue
            end = start + p
            while end < n and words[end] == words[end - p]:
                end += 1
            long = end - start
            if long >= max(least, 2 * p):
                out.append((start, long, p))
    smallest = {}
    for s, long, p in sorted(out, key=lambda r: r[2]):
        if not any(p % q == 0 and s2 == s and l2 == long for (s2, l2, q) in smallest):  # a multiple of the smallest period
            smallest[(s, long, p)] = True
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def plain_lyndon(codes):
    n, out = len(codes), []
    for i in range(n):
        j = i + 1
        while j < n and codes[i:] < codes[j:]:
            j += 1
        out.append(j - i)
    return out


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=600, deadline=None)
def test_lyndon_array_is_its_definition(codes):
    assert runs.lyndon_array(codes) == plain_lyndon(codes)


@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(2, 14))
@settings(max_examples=600, deadline=None)
def test_runs_of_small_alphabets(words, least):
    assert runs.runs_of_words(words, least) == plain_runs(words, least)


def test_runs_of_nested_and_fibonacci_words():
    rng = random.Random(1)
    for _ in range(150):
        base = [rng.choice("abcd") for _ in range(rng.randint(1, 8))]
        words = [rng.choice("abcdxyz") for _ in range(rng.randint(0, 20))] + base * rng.randint(1, 6) + base[: rng.randint(0, len(base))]
        words = (words + [rng.choice("abcd") for _ in range(rng.randint(0, 10))]) * rng.randint(1, 3)
        assert runs.runs_of_words(words, 12) == plain_runs(words, 12)
    a, b = ["a"], ["a", "b"]
    while len(b) < 200:
        a, b = b, b + a
    assert runs.runs_of_words(b, 12) == plain_runs(b, 12)


def test_a_million_words_in_linear_time():
    began = time.time()
    assert runs.runs_of_words(["a"] * 1_000_000) == [(0, 1_000_000, 1)]
    rng = random.Random(2)
    own = [rng.choice("ab") for _ in range(1000)]
    found = runs.runs_of_words(own * 300)
    assert (0, 300_000, 1000) in found
    assert time.time() - began < 60


def plain_row(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, long, p in found for i in range(s + p, s + long)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    main = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *main, digest("".join(f"{s},{long},{p}\n" for s, long, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digest_equals_the_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a\x1cb é\x85 a", " ".join("ab"[i % 2] for i in range(30)), "x\n" * 12, "x\n" * 11]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 90))) for _ in range(250)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, runs string, id int").repartition(5)
    got = runs.runs_digest(runs.with_planted_runs(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 20), (1, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(runs.with_planted_runs(docs)).collect()}
    assert got == {None: (20, [(0, 20, 1)], "a"), 1: (0, [], "")}
    assert runs.runs_digest(runs.with_planted_runs(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, least=1)


def test_names_of_ids_and_texts_are_free(spark):
    docs = spark.createDataFrame([("k", "b a " * 8)], "runs string, _text string").withColumn("_g", F.lit(1))
    assert runs.runs_digest(runs.with_planted_runs(docs, "runs", "_text"), "runs", "_text").first()["n_runs"] == 1
