"""Base spans against the stated patterns, and what contexts add."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import pii


def plain(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        check = sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        if 14 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len([c for c in m[0] if c in "0123456789"]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@given(st.text(alphabet="0123456789.@+-() aé%\n", max_size=80))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@given(st.text(alphabet="0123456789.@ab-", max_size=400))
@settings(max_examples=300, deadline=None)
def test_base_spans_of_dense_texts(text):
    assert pii.base_spans(text) == plain(text)


def test_tokens_equal_the_plain_pattern():
    rnd = random.Random(5)
    slow = re.compile(r"[^\s,;<>\"'|()\[\]{}]*[0-9@][^\s,;<>\"'|()\[\]{}]*")
    for _ in range(3000):
        text = "".join(rnd.choice("ab1@ ,.(\u2003") for _ in range(rnd.randint(0, 30)))
        assert [m.span() for m in pii._TOKEN.finditer(text)] == [m.span() for m in slow.finditer(text)]


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 500_000 + " b@c " + "a" * 500_000, "1." * 500_000, "a@" * 500_000, "+1(" * 300_000, "1 " * 500_000, "a@b." * 250_000, "(1) " * 250_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    pii.occurrences(text, pii.base_spans(text))
    assert time.process_time() - began < 15


def test_groups_of_digits_and_support_of_what_was_found(spark):
    rows = [(i, f"please dial now +1 (2{i % 10}0) 555-01{i:02d} today") for i in range(30)]
    rows += [(100 + i, f"please dial now 555 0199 1{i:02d} or ask for extension 555 0199 1{i:02d} at any hour") for i in range(5)]
    rows += [(200, "extension (555) 777 1234 at any hour"), (201, "the years 1999 2001 and 2003")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS base", "'x' AS spans", "3 AS row")
    got = {r.doc_id: r.spans for r in pii.pii_digest(docs).collect()}
    assert got[100] == "phone:16:28,phone:50:62" and got[200] == "phone:10:24" and not got[201]


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_digest_equals_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (None, ""), (-2, "😀 a@b.co 1.2.3.4 +1 (234) 555-0100 4111 1111 1111 1111"), (-2, "😀 a@b.co")], "doc_id long, text string")
    texts = docs.union(odd)
    got = sorted((tuple(r) for r in pii.pii_digest(texts).collect()), key=repr)
    assert len(got) == texts.count()
    want = []
    for r in texts.collect():
        base = plain(r.text)
        want.append((r.doc_id, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(written(base).encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=repr)
    base = {}
    for r in texts.collect():
        base.setdefault((r.doc_id, len(plain(r.text))), set()).update(written(plain(r.text)).split(","))
    for g in got:
        own = {x for k, v in base.items() if k[0] == g[0] for x in v}
        assert set(g[6].split(",")) >= (own if len([1 for k in base if k[0] == g[0]]) == 1 else set())


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"intro text number please dial now +1 (2{i % 10}0) 555-01{i:02d} today") for i in range(30)]
    rows += [(100, "please dial now 5550199123 today"), (101, "built in the year 20240101 of the log"), (102, "serial code 5550199124 of the log")]
    rows += [(200 + i, f"of the year {20230000 + i} and the log") for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:16:26"
    assert not got[101] and not got[102] and all(not got[200 + i] for i in range(20))


def test_empty(spark):
    assert pii.pii_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
