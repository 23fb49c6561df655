"""Canonical documents by cases, and a migration that is done whole or not at all."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.operators import migration as M


def test_canonical_documents(spark):
    same = [
        ('{"b": 1, "a": {"d": [1, {"y": 2, "x": null}], "c": "é"}}', '{"a":{"c":"é","d":[1,{"x":null,"y":2}]},"b":1,"url":"https://x"}'), ("{}", '{"url": 1}'), (None, "{}"), ("[2, 1]", "[2,1]"), ('"a"', ' "a" '), ('{"k\\"ey": "v"}', '{ "k\\"ey":"v" }'),
    ]
    other = [('{"a": [1, 2]}', '{"a": [2, 1]}'), ('{"a": {"url": 1}}', '{"a": {}}'), ('{"a": null}', "{}"), ('{"a": "1"}', '{"a": 1}')]
    df = spark.createDataFrame(same + other, "a string, b string").select((M.canonical(F.col("a")) == M.canonical(F.col("b"))).alias("same"), M.canonical(F.col("a")).alias("text"))
    rows = df.collect()
    assert [r.same for r in rows] == [True] * len(same) + [False] * len(other)
    assert rows[0].text == '{"a":{"c":"é","d":[1,{"x":null,"y":2}]},"b":1}'


def test_blocks_are_compared_as_wholes(spark):
    schema = "k int, position int, kind string, content string"
    a = spark.createDataFrame([(1, 0, "p", '{"t": 1, "url": "u"}'), (2, 0, "p", "{}"), (2, 1, "p", "{}"), (3, 0, "p", "{}"), (4, 0, "p", None)], schema)
    b = spark.createDataFrame([(1, 0, "p", '{"t": 1}'), (2, 0, "p", "{}"), (3, 0, "q", "{}"), (4, 0, "p", "{}"), (5, 0, "p", "{}")], schema)
    assert sorted(tuple(r) for r in M.same_blocks(a, b, "k").collect()) == [(1, True), (2, False), (3, False), (4, True), (5, False)]
    assert M.same_blocks(a.limit(0), b.limit(0), "k").count() == 0


def tables(spark, placements):
    magazines = spark.createDataFrame([(1, "x", None, None, None), (2, "y", None, None, None)], "magazine int, editorial_title string, editorial_author string, editorial_summary string, editorial_body string")
    articles = spark.createDataFrame([(10, None, 1), (11, 2, 1), (12, None, None)], "article int, pending int, published int")
    versions = spark.createDataFrame([(10, 1, "t", "a", None), (11, 1, "old", "a", "s"), (11, 2, "new", "b", "s")], "article int, version int, title string, author_name string, summary string")
    blocks = spark.createDataFrame([(11, 2, 1, "list", '{"b":2}'), (11, 2, 0, "paragraph", '{"a":1}')], "article int, version int, position int, kind string, content string")
    return M.editorials_moved(magazines, spark.createDataFrame(placements, "magazine int, article int, section string"), articles, versions, blocks)


def test_editorials_move(spark):
    magazines, articles = tables(spark, [(1, 11, "EDITORIAL"), (2, 10, "Tutorial")])
    body = '[{"blockType":"paragraph","content":{"a":1}},{"blockType":"list","content":{"b":2}}]'
    assert sorted(tuple(r) for r in magazines.collect()) == [(1, "new", "b", "s", body), (2, "y", None, None, None)]
    assert sorted(r.article for r in articles.collect()) == [10, 12]
    assert tables(spark, [(2, 10, "Editorial")])[0].filter("magazine = 2").first()["editorial_body"] == "[]"
    magazines, articles = tables(spark, [])
    assert (magazines.count(), articles.count()) == (2, 3)


@pytest.mark.parametrize("placements", [[(1, 12, "editorial")], [(9, 11, "editorial")], [(1, 10, "editorial"), (1, 11, "editorial")]])
def test_a_mismatch_leaves_nothing_behind(spark, tmp_path, placements):
    for k, df in enumerate(tables(spark, placements)):
        out = str(tmp_path / f"t{k}")
        with pytest.raises(PySparkException, match="editorials don't match"):
            df.write.parquet(out)
        assert not os.path.exists(out) or not [f for f in os.listdir(out) if f.startswith("part-")]
