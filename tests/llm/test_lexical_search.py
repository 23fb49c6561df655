"""The scan against a plain ranking, blocks of items, ties, odd tables, and one long text."""

import math
import random
import re

from marginalia.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    found = [(i, terms_of(t)) for i, t in docs]
    big_n, big_l = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = {}
    for _, own in found:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for i, own in found:
            m = 25 + (75 * len(own) * big_n) // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * own.count(t) // (1000 * own.count(t) + 8 * m)) for t in terms_of(text) if t in own)
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def made(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "été", "Zug", "x1", "ß", "日本", "rare", "İ", *[f"w{i}" for i in range(60)]]
    text = lambda most: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\x00", "\n"]) for _ in range(rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!?"), (3, docs[3][1]), *[(n + 10 + i, "THE rare rare w1") for i in range(40)]]
    items = [(i, text(12)) for i in range(25)] + [(25, None), (26, ""), (27, "rare RARE the"), (28, "nowhere"), (27, "rare RARE the")]
    return docs, items


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_the_plain_ranking(spark):
    docs, items = made()
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string").repartition(7)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert rows_of(lexical_search.search(a, b)) == plain(docs, items)
    assert rows_of(lexical_search.search(a, b, k=2)) == plain(docs, items, 2)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 60)
    monkeypatch.setattr(lexical_search, "_SLICE_CELLS", 50)
    docs, items = made(2, 60)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_search.search(a, b)) == plain(docs, items)


def test_guards_ties_nulls_and_empty_tables(spark):
    docs = [(None, "ab ab"), (2, "ab ab"), (1, "AB-ab"), (4, "abab xab abx"), (5, "ab" * 500_000 + " ab"), (6, "zz")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("q", "ab")], "item_id string, text string")
    assert [r.doc_id for r in lexical_search.search(a, b).orderBy("rank").collect()] == [1, 2, None, 5]
    assert rows_of(lexical_search.search(a, b)) == plain(docs, [("q", "ab")])
    assert lexical_search.search(a.limit(0), b).count() == 0
    assert lexical_search.search(a, b.limit(0)).count() == 0
    assert lexical_search.search(a.selectExpr("doc_id", "CAST(NULL AS STRING) AS text"), b).columns == ["item_id", "rank", "doc_id", "score"]
