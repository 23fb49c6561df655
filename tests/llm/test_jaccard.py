"""The join against all pairs."""

import os
import random
import re

import numpy as np
import pytest

from marginalia.llm import jaccard_join as jj
from marginalia.llm.components import components
from marginalia.llm.shared import Scratch


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], "doc_id long, text string, id long, root long, name string").repartition(5)
    return sorted((tuple(r) for r in jj.jaccard_components(docs).collect()), key=repr)


def corpus(seed, families, copies):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ab ba Ca dé fo gu hi jo ki lu".split()) + rnd.choice("xyzwv") * rnd.randint(0, 2)
    passage = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rnd.randint(3, 90))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = word()
            text = " ".join(own)
            rows.append(f"{text} {passage}" if rnd.random() < 0.4 else text)
    rows += [None, "", " \n\t", "One", "one", "One two", "one\x0btwo", "a b c d e", "A B C D E", "a b c d e f"]
    rnd.shuffle(rows)
    return [(None if i == 3 else i, t) for i, t in enumerate(rows)] + [(7, rows[7])]


def test_join_equals_all_pairs(spark):
    rows = corpus(1, 60, 6)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 3])
def test_large_clusters(spark, monkeypatch, rounds):
    monkeypatch.setattr(jj, "UNIT_SETS", 4)
    monkeypatch.setattr(jj, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(jj, "PAIRED", 2)
    rows = corpus(2, 12, 40)
    assert run(spark, rows) == brute(rows)


def test_real_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_of_a_batch_equal_those_alone():
    texts = ["", "a b c d e f g", "  x ", "A b C d E f g", "é " * 9, "w" * 500 + " a b c d"]
    for text, own in zip(texts, jj.shingle_sets(texts), strict=True):
        assert own.tolist() == jj.shingle_sets([text])[0].tolist() and len(own) == len(plain_set(text))


def test_trie_walk_equals_overlap():
    rnd = random.Random(9)
    trie, sets = jj.Trie(80), {}
    for name in range(150):
        base = rnd.choice(list(sets.values())).tolist() if sets and rnd.random() < 0.7 else rnd.sample(range(400), rnd.randint(1, 60))
        own = np.unique(np.array([*base[rnd.randint(0, 1) :], rnd.randrange(400)], dtype=np.uint64))
        want = {k for k, s in sets.items() if jj.linked(len(np.intersect1d(s, own)), len(s), len(own), 80)}
        assert set(trie.walk(own)) == want
        trie.add(own, name)
        sets[name] = own


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t"), "c").collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_sketches_never_part_linked_sets():
    rnd = random.Random(4)
    for _ in range(300):
        x = np.array(rnd.sample(range(1 << 40), rnd.randint(1, 400)), dtype=np.uint64)
        y = np.array([*rnd.sample(x.tolist(), rnd.randint(len(x) * 3 // 4, len(x))), *rnd.sample(range(1 << 40), rnd.randint(0, len(x) // 4))], dtype=np.uint64)
        if len(y) and jj.linked(len(np.intersect1d(x, y)), len(x), len(y), 80):
            assert jj.may_link(jj.sketch(x), jj.sketch(y), len(x), len(y), 80)
    far = [np.array(rnd.sample(range(1 << 40), 3000), dtype=np.uint64) for _ in range(2)]
    assert not jj.may_link(*map(jj.sketch, far), 3000, 3000, 80)


def test_components_end_once_edges_are_stars(spark):
    tmp = Scratch(spark, "stars")
    stars = spark.createDataFrame([(k, k % 3) for k in range(3, 40)], "a long, b long")
    got = {r.node: r.root for r in components(stars, tmp, "s").collect()}
    assert got == {k: k % 3 for k in range(40)}
    assert [x for x in os.listdir(tmp.path.removeprefix("file://")) if x.startswith("s-")] == ["s-0"]
    path = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(60, 61), (61, 60), (62, 62)], "a long, b long")
    assert {r.node: r.root for r in components(path, tmp, "p").collect()} == {k: 0 for k in range(51)} | {60: 60, 61: 60}


def test_components_of_long_paths_take_few_rounds(spark):
    names = random.Random(5).sample(range(1 << 40), 3000)
    tmp = Scratch(spark, "paths")
    path = spark.createDataFrame([*zip(names, names[1:]), (7 << 50, 7 << 50)], "a long, b long").repartition(8)
    assert {r.node: r.root for r in components(path, tmp, "r").collect()} == dict.fromkeys(names, min(names))
    assert max(int(x.removeprefix("r-")) for x in os.listdir(tmp.path.removeprefix("file://"))) <= 3


@pytest.mark.parametrize("close", [False, True])
def test_clusters_that_no_pivot_splits_are_not_split(spark, monkeypatch, close):
    """Near copies at about the threshold: most are near the pivot without a link, so both parts would be nearly all of them. Close copies link with it."""
    monkeypatch.setattr(jj, "UNIT_SETS", 8)
    rnd = random.Random(6)
    sets = {k: np.array(sorted(rnd.sample(range(100), 98 if close else 89)), dtype=np.uint64) for k in range(60)}
    tmp, saved = Scratch(spark, "links"), []
    save = tmp.save
    monkeypatch.setattr(tmp, "save", lambda df, name: saved.append(name) or save(df, name))
    rows = [(1, k, len(sets), 0, bytearray(x.tobytes())) for k, x in sets.items()]
    links = jj._links(tmp.save(spark.createDataFrame(rows, "root long, name long, sets long, pivot long, elements binary"), "members"), tmp, 80)
    got = {r.node: r.root for r in components(links, tmp, "c").collect()}
    want = {k: k for k in sets}
    for _ in sets:
        for i in sets:
            for j in range(i):
                if jj.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80):
                    want[i] = want[j] = min(want[i], want[j])
    assert {k: got.get(k, k) for k in sets} == want
    assert "unit-links-1" in saved and "pivots-1" not in saved
    assert spark.read.parquet(tmp.folder("pool-1")).count() == (0 if close else len(sets))
