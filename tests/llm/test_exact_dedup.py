"""Block naming against comparing whole texts."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup

SCHEMA = "doc_id long, text string, name string, level int, copies string, keys string, n string, id string"


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [x for x in ids if x is not None]
        keep = max(known, default=None)
        first = True
        for x in sorted(ids, key=lambda x: (x is None, x or 0)):
            mine = x == keep and first
            first = first and not mine
            out.append((x, keep, len(ids), mine, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "c", "k", "m", "i") for i, t in rows], SCHEMA).repartition(3)


def corpus():
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab é\n😀") for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    texts = [rnd.choice(base) for _ in range(150)] + ["hot copy " * 9] * 90 + [None, "", " ", "a" * 1_000_000, "a" * 1_000_000, "a" * 999_999 + "b", "A", "a"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows + [(None, "hot copy " * 9), (None, None), (None, "alone"), (None, "alone"), (7, rows[0][1]), rows[3], rows[3], (3, "x"), (3, "y")]


@pytest.mark.parametrize("block_chars", [3, 7, 4096])
def test_groups_equal_whole_texts(spark, block_chars):
    rows = corpus() if block_chars > 3 else [(i, t) for i, t in corpus() if len(t or "") < 1000]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(table(spark, rows), block_chars=block_chars).collect()), key=repr)
    assert got == plain(rows)


def test_a_key_that_is_not_injective_is_replaced(spark, monkeypatch):
    own = exact_dedup._key
    seeds = []

    def weak(block, seed):
        seeds.append(seed)
        return own(block, seed) if seed > 1 else [F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2")]

    monkeypatch.setattr(exact_dedup, "_key", weak)
    rows = [(i, t) for i, t in corpus() if len(t or "") < 1000]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(table(spark, rows), block_chars=7).collect()), key=repr)
    assert got == plain(rows) and max(seeds) == 2


def test_drop_exact_keeps_one_of_each_text(spark):
    rows = corpus()
    docs = table(spark, rows)
    got = exact_dedup.drop_exact(docs, block_chars=64)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted({(x[0], t or "") for x, (_, t) in ((x, r) for r in rows for x in plain(rows) if x[3] and x[0] == r[0] and x[4] == hashlib.sha256((r[1] or "").encode()).hexdigest())}, key=repr)


def test_empty(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0 and exact_dedup.drop_exact(table(spark, [])).count() == 0
