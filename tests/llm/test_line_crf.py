"""The field against enumeration, and its accuracy on rows that no label was learned from."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import line_crf


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    starts = np.array([0, 1, 5, 8])
    odds, w = rng.normal(size=8), rng.normal(size=(2, 2))
    forward, backward = line_crf.chains(odds, starts, w)
    for a, b in itertools.pairwise(starts):
        weight = {}
        for labels in itertools.product((0, 1), repeat=b - a):
            weight[labels] = np.exp(sum(odds[a + i] * y for i, y in enumerate(labels)) + sum(w[x, y] for x, y in itertools.pairwise(labels)))
        for i in range(b - a):
            p = sum(v for k, v in weight.items() if k[i]) / sum(weight.values())
            assert 1 / (1 + np.exp(-(forward + backward)[a + i])) == pytest.approx(p)


def test_features_of_one_text_do_not_depend_on_others():
    texts = ["", None, "a b\n\nB!! C!!\nB!! C!!", "é é\n", "x" * 3000, "\n\n"]
    together, size, starts = line_crf.line_features(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        alone, own, _ = line_crf.line_features(pa.array([text], pa.string()))
        assert np.allclose(together[starts[k] : starts[k + 1]], alone) and size[starts[k] : starts[k + 1]].tolist() == own.tolist()
        assert own.tolist() == [len(x.encode()) for x in (text or "").split("\n")]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0)], docs.schema)
    model = line_crf.fit_on(docs, labels)
    rows = line_crf.scores(docs.union(odd), model).collect()
    assert len(rows) == docs.count() + 3
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95
    kept = {r.doc_id for r in line_crf.keep_good(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted and r.doc_id is not None and r.doc_id >= 0}


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = line_crf.fit_on(docs, none)
    assert [0 <= r.score <= 1 for r in line_crf.scores(docs, model).collect()] == [True, True]
    assert line_crf.scores(docs.limit(0), model).count() == 0


def test_kept_rows_and_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = line_crf.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    odd = docs.selectExpr("*", "'a' AS id", "1 AS score", "named_struct('x', 1) AS y")
    good = {r.doc_id for r in line_crf.scores(odd, model).filter("predicted = 1").collect()}
    kept = line_crf.keep_good(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == good
    assert line_crf.keep_good(odd.limit(0), model).count() == 0


def test_long_documents_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "SAMPLE_LINES", 5)
    docs = spark.createDataFrame([(i, ("a good line of words.\n" if i % 2 else "!!! $$$ ||\n") * (3 + 20 * (i % 3))) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    got = {r.doc_id: r.predicted for r in line_crf.scores(docs, line_crf.fit_on(docs, labels)).collect()}
    assert all(got[i] == i % 2 for i in range(60))
