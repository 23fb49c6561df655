"""Operators on pages."""

import re

from marginalia.operators import pages as P


def test_furniture_is_not_gathered_by_issue(spark):
    rows = [("a", 1, "HEAD\nfirst\n7"), ("a", 2, "  Head\r\n\n\n\nsecond\nx\ny\nz"), ("a", None, "head\nthird\n1234"), ("b", 1, "HEAD\nfourth"), (None, 1, "HEAD"), ("a", 4, None)]
    pages = spark.createDataFrame(rows, "source string, doc_id long, text string")
    found = spark.createDataFrame([("a", "head", 3)], "source string, line string, pages long")
    out = P.strip_furniture(pages, found, "source", "doc_id", "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[source#\d+\], functions=\[[a-z_]*collect_set", plan)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = [("a", 1, "first"), ("a", 2, "second\nx\ny\nz"), ("a", None, "third\n1234"), ("b", 1, "HEAD\nfourth"), (None, 1, "HEAD"), ("a", 4, "")]
    assert got == sorted(want, key=repr)
